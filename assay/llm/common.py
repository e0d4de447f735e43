"""What several operators share: reading tables, fresh names, ordered running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.sources.results import cut_lineage, shared_folder

__all__ = ["cut_lineage", "fresh", "lower_ascii", "read", "running", "shared_folder"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the wanted ones that no column of `df` has, case aside."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column]
) -> DataFrame:
    """Running sums of `totals` by key in `order`, each row's own value included.

    No key is gathered into one task. Rows are dealt by ranges of (keys, order)
    and written out, so that the ranges stay as they are when a task runs again;
    sums within a range are then raised by what the ranges before hold of the
    key, of which there is one row per range and key.
    """
    spark = df.sparkSession
    (part,) = fresh(df, "_range")
    before = {name: f"_before_{i}" for i, name in enumerate(totals)}
    ranged = cut_lineage(
        df.withColumns(totals)
        .repartitionByRange(partitions(spark), *[F.col(k) for k in keys], *order)
        .withColumn(part, F.spark_partition_id())
    )
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(part, *keys).agg(*[F.sum(t).alias(t) for t in totals])
    held = held.select(
        F.col(part).alias("_at"),
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(b) for t, b in before.items()],
    )
    same = F.col(part) == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    summed = ranged.withColumns({t: F.sum(t).over(inside) for t in totals})
    return summed.join(held, same).select(
        *[c for c in df.columns if c not in totals],
        *[(F.col(t) + F.col(b)).alias(t) for t, b in before.items()],
    )
