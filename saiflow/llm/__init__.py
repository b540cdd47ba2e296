"""Training-data operators: dedup, archives, token rollups, sharding, packing, scoring."""
