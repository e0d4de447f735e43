"""Measuring a suite: every aggregate of a dataset's clauses in one scan.

`measure` stays lazy and gives one row per clause. All `fused` clauses are one
`agg` over one scan. Each key set of the distinct and duplicate metrics is one
grouping, shared by every clause on those keys whatever its scope; it is kept
apart because a distinct aggregate beside others copies each row once per
distinct group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import predicates as P
from assay.functions.rows import literal_rows
from assay.operators.metrics import NO_ROWS, Context, Measured, kind_of, metric_named
from assay.spec import Clause, Suite

MEASURED = "clause_id string, value double, detail string, error string"

# Type names of other databases and Spark's name for each.
TYPE_NAMES = {
    "varchar": "string",
    "text": "string",
    "numeric": "decimal",
    "integer": "int",
    "real": "float",
}


def measure(df: DataFrame, suite: Suite, now: datetime) -> DataFrame:
    """(clause_id, value, detail, error) of every clause of a suite on its rows."""
    spark = df.sparkSession
    rows = df.where(P.sql_condition(suite.filter)) if suite.filter else df
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    fused: dict[str, Measured] = {}
    grouped: dict[tuple[str, ...], list[tuple[str, Clause]]] = {}
    parts: list[DataFrame] = []
    errors: dict[str, str] = {}
    for clause_id, _, clause in suite.clause_ids():
        metric = metric_named(clause.metric)
        ctx = Context(clause, types, now, suite.zone)
        problem = metric.input_error(ctx) if metric.input_error else None
        if problem is not None:
            errors[clause_id] = problem
        elif metric.how == "schema":
            parts.append(_one(clause_id, schema_problems(df, clause.options)))
        elif metric.how == "query":
            try:
                parts.append(_one(clause_id, query_value(spark, clause)))
            except AnalysisException as exc:
                errors[clause_id] = masked(exc)
        elif metric.how == "keys":
            try:
                rows.groupBy(*_names(clause.args)).agg(ctx.rows()).schema
                grouped.setdefault(tuple(clause.args), []).append((clause_id, clause))
            except AnalysisException as exc:
                errors[clause_id] = masked(exc)
        else:
            try:
                fused[clause_id] = Measured(*metric.measure(ctx))
            except ValueError as exc:  # an option no column can be built from
                errors[clause_id] = str(exc)
    fused = _resolved(rows, fused, errors)
    if fused:
        parts.append(fused_scan(rows, fused))
    parts += [key_measures(rows, keys, wanted) for keys, wanted in grouped.items()]
    if errors:
        failed = [(i, None, None, text) for i, text in errors.items()]
        parts.append(literal_rows(spark, MEASURED, failed))
    if not parts:
        return literal_rows(spark, MEASURED, [])
    return reduce(DataFrame.unionByName, parts)


def _resolved(
    rows: DataFrame, fused: Mapping[str, Measured], errors: dict[str, str]
) -> dict[str, Measured]:
    """The measures that can be analysed against these rows.

    One analysis for all; only when that fails is each tried alone, so a
    clause naming a column that is gone is the only one in error.
    """
    if not fused:
        return {}
    try:
        rows.agg(*[measured.value for measured in fused.values()]).schema
        return dict(fused)
    except AnalysisException:
        kept = {}
        for clause_id, measured in fused.items():
            try:
                rows.agg(measured.value).schema
                kept[clause_id] = measured
            except AnalysisException as exc:
                errors[clause_id] = masked(exc)
        return kept


def fused_scan(rows: DataFrame, measures: Mapping[str, Measured]) -> DataFrame:
    """All measures as one aggregate row over one scan, turned into long form."""
    columns: list[Column] = []
    cells: list[str] = []
    for i, (clause_id, measured) in enumerate(measures.items()):
        columns.append(measured.value.cast("double").alias(f"v{i}"))
        told = []
        for name, column in (("d", measured.detail), ("e", measured.error)):
            if column is not None:
                columns.append(column.cast("string").alias(f"{name}{i}"))
            told.append(f"{name}{i}" if column is not None else "cast(null as string)")
        cells.append(f"'{clause_id}', v{i}, {', '.join(told)}")
    names = "clause_id, value, detail, error"
    return rows.agg(*columns).selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as ({names})")


def _names(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{key}`") for key in keys]


def key_measures(
    rows: DataFrame, keys: tuple[str, ...], wanted: Sequence[tuple[str, Clause]]
) -> DataFrame:
    """Distinct keys, surplus rows and their share, from one grouping for all scopes.

    Rows with a NULL in any key count only as rows in scope. The grouping
    combines equal keys before the shuffle, so a hot key costs one row per task.
    """
    names = _names(keys)
    whole = reduce(lambda a, b: a & b, [name.isNotNull() for name in names])
    scopes = {where: f"_rows_{i}" for i, where in enumerate({c.where: 0 for _, c in wanted})}
    counts = [
        P.rows_in(P.sql_condition(where) if where else None).alias(name)
        for where, name in scopes.items()
    ]
    groups = rows.groupBy(*names).agg(*counts)
    measures = {}
    for clause_id, clause in wanted:
        n = F.col(scopes[clause.where])
        there = whole & (n > 0)
        surplus = F.coalesce(F.sum(F.when(there, n - 1)), F.lit(0)).cast("double")
        in_scope = F.coalesce(F.sum(n), F.lit(0)).cast("double")
        values = {
            "distinct_count": F.count_if(there).cast("double"),
            "duplicate_count": surplus,
            "duplicate_percent": P.percent(surplus, in_scope),
        }
        nothing = F.when(in_scope == 0, NO_ROWS) if clause.metric.endswith("percent") else None
        measures[clause_id] = Measured(values[clause.metric], nothing)
    return fused_scan(groups, measures)


def query_value(spark: SparkSession, clause: Clause) -> DataFrame:
    """The first value of a user's own query; it must be a number or NULL."""
    result = spark.sql(clause.options["query"])
    first = result.schema.fields[0]
    kind = kind_of(first.dataType)
    value, error = F.first(F.col("answer")), F.lit(None).cast("string")
    answer = F.lit(None).cast("double")
    if kind == "numeric":
        answer = F.col(f"`{first.name}`").cast("double")
    elif not isinstance(first.dataType, T.NullType):
        error = F.lit(f"sql_metric's query must return a number; got {kind}")
    return (
        result.limit(1)
        .select(answer.alias("answer"))
        .agg(value.alias("value"))
        .select(
            "value",
            F.when(F.col("value").isNull(), "query returned NULL").alias("detail"),
            error.alias("error"),
        )
    )


def columns_of(df: DataFrame) -> DataFrame:
    """(name, type) of a DataFrame's columns, from its schema alone."""
    fields = [(f.name.lower(), f.dataType.simpleString().lower()) for f in df.schema.fields]
    return literal_rows(df.sparkSession, "name string, type string", fields)


def schema_expectations(spark: SparkSession, options: Mapping[str, object]) -> DataFrame:
    """(kind, name, type): one row per expectation of a `schema` clause."""
    required = [("required", n.lower(), None) for n in options.get("required_columns", [])]
    forbidden = [("forbidden", n.lower(), None) for n in options.get("forbidden_columns", [])]
    typed = []
    for name, wanted in options.get("column_types", {}).items():
        typed.append(("type", name.lower(), TYPE_NAMES.get(wanted.lower(), wanted.lower())))
    rows = [*required, *forbidden, *typed]
    return literal_rows(spark, "kind string, name string, type string", rows)


def schema_problems(df: DataFrame, options: Mapping[str, object]) -> DataFrame:
    """One row: how many expectations the columns break, and which."""
    wanted = schema_expectations(df.sparkSession, options).alias("w")
    found = columns_of(df).withColumnRenamed("type", "actual").alias("f")
    joined = wanted.join(found, F.col("w.name") == F.col("f.name"), "left")
    present = F.col("f.name").isNotNull()
    problem = (
        F.when(
            (F.col("kind") != "forbidden") & ~present,
            F.concat(F.lit("missing column "), F.col("w.name")),
        )
        .when(
            (F.col("kind") == "forbidden") & present,
            F.concat(F.lit("forbidden column "), F.col("w.name"), F.lit(" is present")),
        )
        .when(
            (F.col("kind") == "type") & ~F.contains(F.col("actual"), F.col("type")),
            F.concat_ws(
                " ", F.col("w.name"), F.lit("is"), F.col("actual"), F.lit("not"), F.col("type")
            ),
        )
    )
    problems = F.array_sort(F.collect_list(problem))  # at most one per expectation
    return joined.agg(F.count(problem).cast("double").alias("value"), problems.alias("p")).select(
        "value",
        F.when(F.size("p") > 0, F.array_join("p", "; ")).alias("detail"),
        F.lit(None).cast("string").alias("error"),
    )


def _one(clause_id: str, measured: DataFrame) -> DataFrame:
    return measured.select(F.lit(clause_id).alias("clause_id"), "value", "detail", "error")


# Error conditions whose text quotes a row's value, and what is
# said instead.
QUOTING = ("CAST_INVALID_INPUT", "CONVERSION_INVALID_INPUT", "CANNOT_PARSE", "INVALID_PARAMETER")
CONVERSION = (
    "a value in the column could not be converted: "
    "the check's options and the column's type disagree"
)


def masked(exc: PySparkException) -> str:
    """An error as text that holds no value of the data."""
    condition = exc.getCondition() or type(exc).__name__
    if any(word in condition for word in QUOTING):
        return CONVERSION
    if isinstance(exc, AnalysisException):
        return str(exc).splitlines()[0]
    return f"the measure could not be taken ({condition})"


# How many parts of a dataset are measured at a time.
PARTS_AT_A_TIME = 4


def measure_isolated(df: DataFrame, suite: Suite, now: datetime) -> DataFrame:
    """`measure`, run now, so that a clause that fails does so alone.

    The shared scan, each key set and each query are jobs of their own, side by
    side. One that fails is measured again in halves; the others stand. What
    reaches the driver is one row per clause.
    """
    parts: dict[tuple[str, ...], list[str]] = {}
    for clause_id, _, clause in suite.clause_ids():
        how = metric_named(clause.metric).how
        kind = {"keys": tuple(clause.args), "query": (clause_id,)}.get(how, ())
        parts.setdefault((how, *kind), []).append(clause_id)

    def attempt(ids: list[str]) -> list[tuple]:
        try:
            return [tuple(r) for r in measure(df, only(suite, ids), now).collect()]
        except PySparkException as exc:
            if len(ids) == 1:
                return [(ids[0], None, None, masked(exc))]
            half = len(ids) // 2
            return attempt(ids[:half]) + attempt(ids[half:])

    with ThreadPoolExecutor(PARTS_AT_A_TIME) as pool:
        rows = [row for part in pool.map(attempt, parts.values()) for row in part]
    return literal_rows(df.sparkSession, MEASURED, rows)


def only(suite: Suite, ids: Sequence[str]) -> Suite:
    """The suite with the clauses of these identities alone."""
    kept: dict[str, list[Clause]] = {}
    for clause_id, check, clause in suite.clause_ids():
        if clause_id in ids:
            kept.setdefault(check.name, []).append(clause)
    checks = [replace(c, clauses=tuple(kept[c.name])) for c in suite.checks if c.name in kept]
    return replace(suite, checks=tuple(checks))
