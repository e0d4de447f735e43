"""Running suites: measure, judge, fold, and the rows the result tables keep."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.outcomes import severity
from assay.functions.predicates import finite
from assay.functions.rows import literal_rows
from assay.operators.change import NO_BASELINES, judge_changes
from assay.operators.judge import display_value, fold_checks, judge, rules_of, run_rollup
from assay.operators.measure import measure, measure_isolated
from assay.sources.results import cut_lineage
from assay.spec import Suite

# How many datasets are measured at a time, unless a run says otherwise.
DATASETS_AT_A_TIME = 8
# What a clause result keeps of its baseline.
PREVIOUS_KINDS = {
    "previous": "double", "previous_at": "timestamp", "previous_run": "string", "samples": "bigint",
    "oldest": "timestamp",
}


@dataclass(frozen=True)
class RunFrames:
    """One run as rows of the three result tables."""

    runs: DataFrame
    results: DataFrame
    clauses: DataFrame


def clause_results(
    df: DataFrame,
    suite: Suite,
    now: datetime,
    baselines: DataFrame | None = None,
    isolate: bool = False,
) -> DataFrame:
    """A suite's clauses measured on a dataset and judged.

    `baselines` (`clause_id, previous`, and more of `PREVIOUS`) is what its `change` clauses compare
    with; without it they have no earlier result.
    """
    spark = df.sparkSession
    rules = rules_of(spark, suite)
    measured = (measure_isolated if isolate else measure)(df, suite, now)
    plain = judge(measured, rules.where(F.col("change").isNull()))
    nothing = {name: F.lit(None).cast(kind) for name, kind in PREVIOUS_KINDS.items()}
    plain = plain.withColumns({"measured": F.col("value"), **nothing})
    if any(clause.change for _, _, clause in suite.clause_ids()):
        if baselines is None:
            baselines = literal_rows(spark, NO_BASELINES, [])
        rows = judge_changes(measured, baselines, rules.where(F.col("change").isNotNull()))
        missing = {n: c for n, c in nothing.items() if n not in rows.columns}
        plain = plain.unionByName(rows.withColumns(missing))
    return plain.withColumn("display_value", display_value())


def run_suites(
    suites: Sequence[tuple[Suite, DataFrame]],
    now: datetime,
    *,
    project: str,
    run_id: str | None = None,
    run_key: str | None = None,
    baselines: DataFrame | None = None,
    fail_on: str = "fail",
    isolate: bool = True,
    at_a_time: int = DATASETS_AT_A_TIME,
) -> RunFrames:
    """One run over several datasets, each measured in its own scan.

    Datasets are measured side by side, each once, whatever is then read of the run.
    """
    run_id = run_id or uuid.uuid4().hex
    stamp = {
        "run_id": F.lit(run_id),
        "project": F.lit(project),
        "started_at": F.lit(now).cast("timestamp"),
    }
    with ThreadPoolExecutor(at_a_time) as pool:
        judged = list(
            pool.map(lambda s: clause_results(s[1], s[0], now, baselines, isolate), suites)
        )
    clauses = reduce(DataFrame.unionByName, judged).withColumns(
        {**stamp, "value": finite(F.col("value")), "measured": finite(F.col("measured"))}
    )
    if not isolate:  # else measures are rows already
        clauses = cut_lineage(clauses)
    checks = checks_of(suites[0][1].sparkSession, [suite for suite, _ in suites])
    # A result's identity comes from its run and check, so a task that runs again
    # gives the same; histories need it, and the metric, to be read.
    result_id = F.xxhash64("run_id", "check_id")
    clauses = clauses.withColumn("result_id", result_id)
    first = clauses.groupBy("check_id").agg(F.min_by("metric", "position").alias("metric"))
    results = fold_checks(clauses).join(checks, "check_id").join(first, "check_id")
    results = results.withColumns(stamp).withColumn("result_id", result_id)
    totals = run_rollup(results, "run_id", "position", fail_on)
    runs = totals.select(
        *[column.alias(name) for name, column in stamp.items()],
        "outcome",
        "exit_code",
        "total",
        F.col("pass").alias("passed"),
        F.col("warn").alias("warned"),
        F.col("fail").alias("failed"),
        F.col("error").alias("errored"),
        F.lit(run_key).cast("string").alias("run_key"),
    )
    return RunFrames(runs, results, clauses)


CHECKS = (
    "check_id string, position int, name string, expression string, notify array<string>, "
    "dataset string, datasource string, owner string, tags array<string>, source string"
)


def checks_of(spark: SparkSession, suites: Sequence[Suite]) -> DataFrame:
    """One row per enabled check of the suites, in written order."""
    listed = [(s, check) for s in suites for check in s.checks if check.enabled]
    rows = [
        (
            suite.check_id(check),
            position,
            check.name,
            check.expression,
            check.notify,
            suite.dataset,
            suite.datasource,
            suite.owner,
            suite.tags,
            suite.path,
        )
        for position, (suite, check) in enumerate(listed)
    ]
    return literal_rows(spark, CHECKS, rows)


def problems_first(results: DataFrame) -> DataFrame:
    """A run's results, worst first, then in written order."""
    return results.orderBy(severity(F.col("outcome")).desc(), "position")
