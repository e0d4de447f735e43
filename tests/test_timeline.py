"""Intervals of heads against plain restatements, at random."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay.operators import ordered, state, timeline
from tests.test_state import SCHEMA, START, as_heads, random_history, sequential


def as_places(df):
    return {(r.check_id, r.started_at, r.run_id): tuple(r)[1:] for r in df.select(*state.HEAD).collect()}


def test_every_result_has_the_head_of_a_recompute(spark):
    rows = random_history(21, checks=25)
    replayed = timeline.replayed(spark.createDataFrame(rows, SCHEMA))
    found = as_places(replayed)
    for check, result, run, at, _ in rows:
        upto = [r for r in rows if r[0] == check and (r[3], r[2]) <= (at, run)]
        assert found[check, at, run] == sequential(upto)[0][check]
    events = {r.result_id: (r.event, r.previous_outcome) for r in timeline.changes_of(replayed).collect()}
    assert events == sequential(rows)[1]


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 6])
def test_the_state_as_of_any_run_is_a_lookup(spark, hot_rows, tmp_path):
    rows = random_history(22, checks=20)
    replayed = timeline.replayed(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows)
    timeline.binned(timeline.closed_of(replayed)).write.partitionBy("bin").parquet(str(tmp_path / "closed"))
    closed = spark.read.parquet(str(tmp_path / "closed"))
    heads = timeline.heads_of(replayed)
    assert as_heads(heads) == sequential(rows)[0]
    for at, run in [(START + timedelta(hours=h), "r50") for h in (0, 1, 24, 120, 299, 300, 400)]:
        cut = [r for r in rows if (r[3], r[2]) <= (at, run)]
        assert as_heads(timeline.as_of(heads, closed, at, run)) == sequential(cut)[0]


def test_a_lookup_reads_few_partitions_and_no_result(spark, tmp_path):
    rows = [(1, i, f"r{i:04d}", START + timedelta(days=i), "pass") for i in range(400)]
    replayed = timeline.replayed(spark.createDataFrame(rows, SCHEMA))
    timeline.binned(timeline.closed_of(replayed)).write.partitionBy("bin").parquet(str(tmp_path / "closed"))
    timeline.heads_of(replayed).write.parquet(str(tmp_path / "heads"))
    closed, heads = (spark.read.parquet(str(tmp_path / n)) for n in ("closed", "heads"))
    assert closed.select("bin").distinct().count() > 350
    found = timeline.as_of(heads, closed, START + timedelta(days=100, hours=1), "r9")
    assert [r.result_id for r in found.collect()] == [100]
    day = (START - datetime(1970, 1, 1)).days + 100
    assert closed.where(F.col("bin").isin(*timeline.bins_at(day))).count() <= timeline.MOST_LEVELS + 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bin" in plan and plan.count("FileScan") == 2


@pytest.mark.parametrize("seed", range(3))
def test_advancing_with_late_results_equals_replaying_all(spark, seed):
    rows = random_history(seed + 200, checks=40)
    draw = random.Random(seed)
    history = spark.createDataFrame(rows, SCHEMA)
    batch = {r[1] for r in rows if draw.random() < 0.1 or r[0] % 15 == 1}
    marked = history.withColumn("new", F.col("result_id").isin(*batch))
    before = timeline.replayed(marked.where(~F.col("new")))
    heads, closed, changes = timeline.heads_of(before), timeline.closed_of(before), timeline.changes_of(before)
    moved = timeline.advance(heads, closed, marked.where("new"), history)
    wanted, events = sequential(rows)
    assert as_heads(moved.heads) == wanted
    after = timeline.still_closed(closed, moved.late).unionByName(moved.closed)
    everything = timeline.closed_of(timeline.replayed(history))
    assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, everything.collect()), key=str)
    told = timeline.still_changes(changes, moved.late).unionByName(moved.changes).collect()
    assert {r.result_id: (r.event, r.previous_outcome) for r in told} == events and len(told) == len(events)


def test_a_late_result_reads_only_what_lies_after_it(spark):
    rows = [(c, c * 100 + i, f"r{i:02d}", START + timedelta(days=i), "pass") for c in range(3) for i in range(50)]
    late = (1, 999, "late", START + timedelta(days=40, hours=1), "fail")
    history = spark.createDataFrame([*rows, late], SCHEMA)
    before = timeline.replayed(history.where("run_id <> 'late'"))
    early = F.col("started_at") < F.lit(late[3]).cast("timestamp")
    other = F.col("check_id") != 1
    unreadable = history.withColumn(
        "outcome", F.when(early | other, F.raise_error(F.lit("read too much"))).otherwise(F.col("outcome"))
    )
    moved = timeline.advance(
        timeline.heads_of(before), timeline.closed_of(before), history.where("run_id = 'late'"), unreadable
    )
    assert as_heads(moved.heads) == sequential([*rows, late])[0]
    assert {r.event for r in moved.changes.collect()} == {"failing", "recovered"}


def test_results_that_go_reopen_what_was_before(spark):
    rows = [(1, 1, "a", START, "pass"), (1, 2, "b", START + timedelta(days=1), "fail"), (2, 3, "b", START + timedelta(days=1), "fail")]
    history = spark.createDataFrame(rows, SCHEMA)
    before = timeline.replayed(history)
    gone = history.where("run_id = 'b'")
    moved = timeline.advance(
        timeline.heads_of(before), timeline.closed_of(before), history.limit(0), history.where("run_id = 'a'"), gone=gone
    )
    assert as_heads(moved.heads) == sequential(rows[:1])[0]
    assert timeline.still_closed(timeline.closed_of(before), moved.late).count() == 0
    assert timeline.still_changes(timeline.changes_of(before), moved.late).count() == 0


def test_heads_carry_columns_of_their_result(spark):
    rows = [(1, i, f"r{i}", START + timedelta(hours=i), "pass") for i in range(4)]
    history = spark.createDataFrame(rows, SCHEMA).withColumn("message", F.concat(F.lit("said "), F.col("run_id")))
    before = timeline.replayed(history.where("run_id < 'r3'"), carry=["message"])
    heads, closed = timeline.heads_of(before, ["message"]), timeline.closed_of(before)
    assert sorted(r.message for r in closed.collect()) == ["said r0", "said r1"]
    moved = timeline.advance(heads, closed, history.where("run_id = 'r3'"), history, ["message"])
    assert [r.message for r in moved.heads.collect()] == ["said r3"]


def test_replaying_is_one_shuffle(spark, tmp_path):
    spark.createDataFrame(random_history(1), SCHEMA).write.parquet(str(tmp_path / "h"))
    rows = timeline.replayed(spark.read.parquet(str(tmp_path / "h")), hot_rows=None)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") <= 2, plan


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 6])
def test_replaying_from_seeds_gives_intervals_and_heads_of_seeds_too(spark, hot_rows):
    rows = random_history(23, checks=12)
    history = spark.createDataFrame(rows, SCHEMA)
    middle = START + timedelta(hours=100)
    early = timeline.replayed(history.where(F.col("started_at") < F.lit(middle)))
    late = history.where(F.col("started_at") >= F.lit(middle))
    rest = timeline.replayed(late, timeline.heads_of(early), hot_rows=hot_rows)
    assert as_heads(timeline.heads_of(rest)) == sequential(rows)[0]
    found = timeline.closed_of(early).unionByName(timeline.closed_of(rest)).collect()
    wanted = timeline.closed_of(timeline.replayed(history)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, wanted), key=str)
    told = timeline.changes_of(early).unionByName(timeline.changes_of(rest)).collect()
    assert {r.result_id: (r.event, r.previous_outcome) for r in told} == sequential(rows)[1]


def test_replaying_from_seeds_is_one_shuffle_and_heads_are_no_other(spark, tmp_path):
    heads = timeline.heads_of(timeline.replayed(spark.createDataFrame(random_history(1), SCHEMA)))
    heads.write.parquet(str(tmp_path / "heads"))
    spark.createDataFrame(random_history(2), SCHEMA).write.parquet(str(tmp_path / "h"))
    history, seeds = (spark.read.parquet(str(tmp_path / n)) for n in ("h", "heads"))
    rows = timeline.replayed(history, seeds, hot_rows=None)
    for part in (rows, timeline.heads_of(rows), timeline.closed_of(rows)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
