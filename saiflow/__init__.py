"""saiflow — Spark-native sector-attention analytics.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``DataFrame.transform``) built from Spark SQL expressions, joins,
aggregates and windows. Nothing inside an operator collects data to the
driver.
"""

__version__ = "0.1.0"
