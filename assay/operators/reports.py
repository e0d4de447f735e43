"""Rows of the machine-readable and human reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import PROBLEM_ORDER, known_outcome, outcome_counts, position_in
from assay.functions.predicates import finite
from assay.operators.state import heads_as_of


def report_rows(results: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per check result with its clauses as an array, in written order.

    A check has as many clauses as its author wrote, so the arrays stay short.
    """
    clause = F.struct(
        "position",
        "clause_id",
        "clause_key",
        "expression",
        "metric",
        "outcome",
        finite(F.col("value")).alias("value"),
        "message",
        finite(F.col("measured")).alias("measured"),
        "unit",
        *(["display_value"] if "display_value" in clauses.columns else []),
        compared_with(clauses),
    )
    listed = clauses.groupBy("result_id").agg(
        F.array_sort(F.collect_list(clause)).alias("clauses")
    )
    # A run's results come with their number of clauses under the same name.
    return results.drop("clauses").join(listed, "result_id", "left")


def compared_with(clauses: DataFrame) -> Column:
    """What a clause was compared with: value, run, time, baseline and number of runs.

    Clauses that know the value alone have that.
    """
    previous = F.col("previous")
    if not {"previous_run", "previous_at", "samples", "change"} <= set(clauses.columns):
        return previous
    known = F.struct(
        finite(previous).alias("value"),
        F.col("previous_run").alias("run_id"),
        F.col("previous_at").alias("started_at"),
        F.col("change").alias("baseline"),
        F.col("samples").alias("runs"),
    )
    return F.when(previous.isNotNull(), known).alias("previous")


def report_junit_counts(results: DataFrame) -> DataFrame:
    """Per run and dataset, as test suites: tests, failures, errors, skipped, seconds."""
    rolled = results.groupBy("run_id", "dataset").agg(
        *outcome_counts(F.col("outcome")),
        F.min_by("duration_ms", "position").alias("duration_ms"),
    )
    return rolled.select(
        "run_id",
        "dataset",
        F.col("total").alias("tests"),
        F.col("fail").alias("failures"),
        F.col("error").alias("errors"),
        "skipped",
        (F.col("duration_ms") / 1000).alias("seconds"),
    )


def report_as_of(history: DataFrame, started_at: Column, run_id: Column) -> DataFrame:
    """A run's results, problems first, with since when each held at that run."""
    heads = heads_as_of(history, started_at, run_id).select("check_id", "since")
    rows = history.where(F.col("run_id") == run_id).withColumn(
        "outcome", known_outcome(F.col("outcome"))
    )
    since = F.when(F.col("outcome") != "pass", F.col("since"))
    return (
        rows.join(heads, "check_id", "left")
        .withColumn("since", since)
        .orderBy(position_in(F.col("outcome"), PROBLEM_ORDER), "result_id")
    )
