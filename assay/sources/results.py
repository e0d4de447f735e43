"""The result tables: appending runs, replacing a retried dataset, reading back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("runs", "results", "clauses")


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach: below `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/assay-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written and read back, so a lost executor repeats nothing before."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """An intermediate result, written out so that its size is known.

    Spark picks its join by that size: a small table is broadcast and the large
    side is not shuffled; otherwise both are, and hot keys split at run time.
    """
    return cut_lineage(df)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("started_at"))


def write_results(
    root: str, runs: DataFrame, results: DataFrame, clauses: DataFrame, by: str = "day"
) -> None:
    """Append a batch of runs to the three tables, by project and day.

    The runs go last: a result counts only once its run is there and finished
    (`read_history` joins them), so a write that stops halfway shows nothing.
    Rows are brought together by partition first, so that a batch writes few
    files per project and day, and a day too large for one task is split; `by`
    names another column of the rows to use.
    """
    for name, df in (("clauses", clauses), ("results", results), ("runs", runs)):
        rows = with_day(df) if by == "day" else df
        rows = rows.hint("rebalance", "project", by)
        rows.write.mode("append").partitionBy("project", by).parquet(f"{root}/{name}")


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no such result table: {name}")
    return spark.read.parquet(f"{root}/{name}")


def replace_dataset(root: str, attempt: DataFrame) -> None:
    """Put a retried dataset's results in place of its earlier ones of the same run.

    The days of the attempt are rewritten as a whole, without the old results of
    its runs and datasets; no other day is read.
    """
    attempt = with_day(attempt)
    where, what = ["project", "day"], ["run_id", "datasource", "dataset"]
    stored = read_results(attempt.sparkSession, root, "results")
    days = attempt.select(*where).distinct()
    kept = stored.join(days, where, "left_semi").join(attempt.select(*what), what, "left_anti")
    rows = cut_lineage(kept.unionByName(attempt, allowMissingColumns=True))
    whole = rows.hint("rebalance", *where).write.mode("overwrite")
    whole.option("partitionOverwriteMode", "dynamic").partitionBy(*where).parquet(f"{root}/results")
