"""Sources and sinks: files, parquet tables, JDBC and parameterised SQL."""

from .files import (  # noqa: F401
    read_calendar, read_posts_csv, read_sector_list, read_table, read_terms,
    read_viewpoints, read_word_vectors,
)
from .sinks import append_by_name, overwrite_partitions, write_tsv  # noqa: F401
from .sql import jdbc_read, param_sql  # noqa: F401
