"""Measures from Parquet footers: a count or a bound of whole files needs no data page.

Footers hold the rows, the NULLs and the bounds of every column of a row group, so
`row_count`, `missing_count`, `min` and `max` of all rows are sums and extremes of
those. Spark reads them in tasks, a file at a time, where its own aggregate
push-down is on; that is done in a session of its own, so the caller's stays as
it is. Everything else is measured by the fused scan.

Only what footers tell exactly is taken from them: clauses without `where`, of
suites without a filter; no values that stand for missing ones; bounds of whole
numbers alone, since text is cut short there, NaN left out and a decimal's scale not
applied. Files whose footers lack a bound are scanned.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.rows import literal_rows
from assay.operators.measure import MEASURED, measure, only
from assay.operators.metrics import NO_VALUES
from assay.spec import Clause, Suite

#: Types whose bounds in a footer are those of the values.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def in_footers(clause: Clause, types: Mapping[str, T.DataType]) -> bool:
    """Whether footers alone answer a clause on all rows of a table of these columns."""
    if clause.where or clause.options:
        return False
    if clause.metric == "row_count":
        return True
    if clause.metric not in ("missing_count", "min", "max"):
        return False
    dtype = types.get(clause.args[0].lower())
    if clause.metric == "missing_count":
        return isinstance(dtype, T.AtomicType)
    return isinstance(dtype, BOUNDED)


def footer_totals(spark: SparkSession, path: str, clauses: Mapping[str, Clause]) -> DataFrame:
    """One row with the rows of all files, and a count or a bound for each clause."""
    session = spark.newSession()
    by_file = session.conf.get("spark.sql.sources.useV1SourceList").split(",")
    others = ",".join(s for s in by_file if s.strip().lower() != "parquet")
    session.conf.set("spark.sql.sources.useV1SourceList", others)
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    made = {"missing_count": F.count, "min": F.min, "max": F.max}
    totals = [
        made[c.metric](F.col(f"`{c.args[0]}`")).alias(clause_id)
        for clause_id, c in clauses.items()
        if c.metric != "row_count"
    ]
    return session.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *totals)


def measure_files(spark: SparkSession, path: str, suite: Suite, now: datetime) -> DataFrame:
    """`measure` of the Parquet files at a path; footers are read now, the scan is lazy.

    The driver gets one row of footer totals. An empty table has no rows, none missing and
    no bounds.
    """
    df = spark.read.parquet(path)
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    told = {
        clause_id: clause
        for clause_id, _, clause in suite.clause_ids()
        if not suite.filter and in_footers(clause, types)
    }
    if not told:
        return measure(df, suite, now)
    try:
        totals = footer_totals(spark, path, told).first().asDict()
    except (PySparkException, Py4JJavaError):  # a file without the statistics
        return measure(df, suite, now)
    rows = []
    for clause_id, clause in told.items():
        value = totals["rows"] if clause.metric == "row_count" else totals[clause_id]
        if clause.metric == "missing_count":
            value = totals["rows"] - value
        told_nothing = NO_VALUES if value is None else None
        rows.append((clause_id, None if value is None else float(value), told_nothing, None))
    found = literal_rows(spark, MEASURED, rows)
    rest = [clause_id for clause_id, _, _ in suite.clause_ids() if clause_id not in told]
    return found.unionByName(measure(df, only(suite, rest), now)) if rest else found
