"""Tables as datasets: catalog tables and views, and databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view by its name, `schema.table` or `table`."""
    return spark.table(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_by: str | None = None,
    low: object = None,
    high: object = None,
    splits: int = 1,
    fetch: int = 10_000,
    **options: str,
) -> DataFrame:
    """A database table over JDBC, read in `splits` ranges of a column at once.

    Filters, needed columns and aggregates reach the database where Spark can
    push them. The driver's jar must be on the session's class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **options)
    reader = reader.option("pushDownAggregate", True)
    if split_by is not None:
        reader = reader.options(
            partitionColumn=split_by, lowerBound=low, upperBound=high, numPartitions=splits
        )
    return reader.load()
