"""How often and by what the plans of history queries deal the lines; nothing is timed."""

from itertools import count

import pytest

from assay.plans.catalog import QUERIES
from assay.plans.fixtures import TASK_BYTES, derived, lines_by_order

SF_DIR = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_history_is_put_together_in_one_shuffle_of_lines(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1m")  # the join of suppliers and nations is estimated at more
    try:
        plan = plan_of(derived(spark, SF_DIR, "history"))
    finally:
        spark.conf.set(threshold, before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and not any("check_id" in line for line in dealt), dealt  # lines and orders


def test_tasks_get_no_more_lines_as_the_table_grows(spark, monkeypatch):
    few = lines_by_order(spark, SF_DIR).rdd.getNumPartitions()
    monkeypatch.setattr("assay.plans.fixtures.TASK_BYTES", TASK_BYTES // 64)
    assert lines_by_order(spark, SF_DIR).rdd.getNumPartitions() > few


@pytest.mark.parametrize("name", ["report_junit_counts", "keyed_run_tally", "run_rollup"])
def test_counts_of_runs_stay_where_their_lines_are(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    "name",
    ["baselines_stored", "incremental_state", "join_heads", "report_as_of", "alerts_to_write", "notification_batches", "join_alerts"],
)
def test_a_history_read_more_than_once_is_written_out(spark, name):
    read = QUERIES[name](spark, SMALL).inputFiles()
    assert not [path for path in read if "lineitem" in path]


def test_deliveries_of_threads_are_derived_once(spark):
    read = QUERIES["alerts_pending"](spark, SMALL).inputFiles()
    assert not [path for path in read if "lineitem" in path]


def test_a_written_history_has_the_columns_it_stores_alone(spark, tmp_path, monkeypatch):
    from assay.plans import files
    from assay.sources import results

    names = (str(tmp_path / f"f{i}") for i in count())
    monkeypatch.setattr(results, "shared_folder", lambda _: next(names))
    files.write_results(spark, SMALL)
    inputs = [spark.read.parquet(str(p)) for p in tmp_path.iterdir() if not (p / "results").exists()]
    wide = [df.columns for df in inputs if {"dataset", "expression"} & set(df.columns) and "result_id" in df.columns]
    assert inputs and not wide, wide


def test_definitions_are_grouped_where_their_lines_are(spark):
    from assay.plans.lifecycles import definitions

    assert plan_of(definitions(spark, SF_DIR, 0)).count("Exchange hashpartitioning") == 1
