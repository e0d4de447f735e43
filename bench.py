"""Times the headline queries on the tables at $BENCH_SF_DIR; prints one JSON line.

History queries run over result tables that are written first, as a store has
them; `setup_sec` is that writing. Every query runs once to warm up and is then
timed as the median of a few runs.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import change, lifecycle, record, rollups, series, state, timeline
from assay.operators import history as history_operators
from assay.plans import catalog
from assay.plans.fixtures import derived, table
from assay.plans.measuring import FUSED, clause, values
from assay.sources.log import Log
from assay.sources.results import shared_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
# The one store with a published figure: 500 checks by 2,000 runs.
CHECKS, STARTS = 500, 2000


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("assay-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def million_results(spark: SparkSession) -> DataFrame:
    """500 checks by 2,000 hourly runs, outcomes drawn from the given lines."""
    lines = table(spark, SF_DIR, "lineitem")
    drawn = F.pmod(F.hash("l_orderkey", "l_partkey"), F.lit(CHECKS * STARTS))
    noise = lines.groupBy(drawn.alias("place")).agg(F.sum("l_quantity").alias("value"))
    grid = spark.range(CHECKS * STARTS).join(noise, F.col("id") == F.col("place"), "left")
    number = F.coalesce("value", F.lit(31.0)).cast("long")
    outcome = F.when(number % 13 == 0, "fail").when(number % 17 == 0, "error").otherwise("pass")
    run = F.floor(F.col("id") / CHECKS)
    started = F.timestamp_seconds(F.lit(1_700_000_000) + run * 3600)
    return grid.select(
        F.col("id").alias("result_id"),
        (F.col("id") % CHECKS).alias("check_id"),
        F.format_string("r%06d", run).alias("run_id"),
        started.alias("started_at"),
        outcome.alias("outcome"),
        number.cast("double").alias("value"),
    )


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = shared_folder(spark)
    began = time.perf_counter()
    derived(spark, SF_DIR, "history").write.parquet(f"{folder}/history")
    million_results(spark).write.parquet(f"{folder}/million")
    history = spark.read.parquet(f"{folder}/history")
    million = spark.read.parquet(f"{folder}/million")
    # The store of the overview: checks, runs and heads as tables of their own.
    million.groupBy("check_id").agg(
        F.lit("active").alias("state"), F.max("run_id").alias("name")
    ).write.parquet(f"{folder}/checks")
    million.groupBy("run_id").agg(
        F.max("started_at").alias("started_at"), F.lit("main").alias("project")
    ).write.parquet(f"{folder}/runs")
    state.current_heads(million).write.parquet(f"{folder}/heads")
    earlier = million.where("run_id <> 'r001999'")
    state.current_heads(earlier).write.parquet(f"{folder}/earlier_heads")

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    # The same as runs are recorded: one table of heads with what the list shows of them.
    log = Log(spark, f"{folder}/log")
    shown = million.withColumns(
        {"name": F.concat(F.lit("check "), F.col("check_id")), "message": F.col("outcome")}
    )
    carry = ("name", "message", "value")
    replayed = timeline.replayed(shown, carry=carry)
    heads = log.write("heads", timeline.heads_of(replayed, carry).coalesce(1))
    log.commit(log.snapshot(), replaced=[heads])
    timeline.binned(timeline.closed_of(replayed)).write.parquet(f"{folder}/closed")
    before_last = timeline.replayed(shown.where("run_id <> 'r001999'"), carry=carry)
    timeline.heads_of(before_last, carry).write.parquet(f"{folder}/carried")
    timeline.closed_of(before_last).write.parquet(f"{folder}/closed_before")

    def overview() -> None:
        """What the published request shows: every check's newest result and state, and their counts."""
        rows = record.overview(log).toArrow()
        rows.group_by("outcome").aggregate([("check_id", "count")])

    def overview_joined() -> None:
        """The same joined from heads, checks, results and runs."""
        rows = history_operators.join_heads(
            stored("heads"), stored("checks"), stored("million"), stored("runs")
        )
        rows.toArrow()
        rollups.status_counts(rows).collect()

    def as_of() -> None:
        """Every check's state as of a run in the middle of the history."""
        at = datetime(2023, 11, 14) + timedelta(hours=1000)
        timeline.as_of(record.overview(log), stored("closed"), at, "r").toArrow()

    def late() -> None:
        """One late result: what lies after it is replayed."""
        newest = shown.where("run_id = 'r001998' and check_id = 7").withColumn("run_id", F.lit("r001998late"))
        both = shown.unionByName(newest.withColumn("result_id", F.lit(-1).cast("long")))
        moved = timeline.advance(
            stored("carried"), stored("closed_before"), both.where("run_id = 'r001998late'"), both, carry
        )
        run(moved.heads)

    setup = time.perf_counter() - began

    measured = history.selectExpr(
        "check_id as clause_id", "value as measured", "metric", "started_at", "run_id", "run_key"
    )
    results = history.select("check_id", "result_id", "run_id", "started_at", "outcome")
    recorded = history.selectExpr(
        "check_id", "started_at", "run_id", "md5(expression) as fingerprint"
    )
    lines = table(spark, SF_DIR, "lineitem")
    keys = clause("duplicate_count", "l_orderkey", "l_linenumber")
    newest = million.where("run_id = 'r001999'")
    before = stored("earlier_heads").select(*state.HEAD)
    cases = {
        "count_star": lambda: lines.agg(F.count(F.lit(1))).collect(),
        "fused_scan_12_clauses": lambda: values(lines, *FUSED).collect(),
        "duplicate_count": lambda: values(lines, keys).collect(),
        "orders_suite": lambda: catalog.flagship(spark, SF_DIR).collect(),
        "overview_500_checks": overview,
        "overview_500_checks_joined": overview_joined,
        "state_as_of_500_checks": as_of,
        "late_result_in_1m": late,
        "replay_1m_results": lambda: run(timeline.replayed(million)),
        "heads_from_1m_results": lambda: run(state.current_heads(million)),
        "advance_heads_by_one_run": lambda: run(state.advance_heads(before, newest, million)),
        "state_changes_1m_results": lambda: run(state.state_changes(million)),
        "heads_from_history": lambda: run(state.current_heads(results)),
        "state_changes": lambda: run(state.state_changes(results)),
        "baseline_previous": lambda: run(change.previous_backfill(measured)),
        "baseline_same_weekday": lambda: run(change.same_weekday_backfill(measured)),
        "baseline_last_7": lambda: run(change.last_runs_backfill(measured, 7)),
        "value_segments": lambda: run(series.value_segments(history, F.lit("sum"))),
        "definition_versions": lambda: run(lifecycle.definition_versions(recorded)),
        "history_summary": lambda: run(series.history_summary(history, F.lit("sum"))),
    }
    seconds = {}
    for name, case in cases.items():
        case()
        took = []
        for _run in range(10 if name.startswith("overview") else RUNS):
            start = time.perf_counter()
            case()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 4)
    print(
        json.dumps(
            {
                "metric": "total of headline queries, median of runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "setup_sec": round(setup, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
