"""State, changes and ordered operators against plain restatements, at random."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay.operators import change, lifecycle, ordered, series, state

START = datetime(2024, 1, 1)
WORDS = ("pass", "warn", "fail", "error", "skipped", "mystery")
KNOWN = WORDS[:5]
SCHEMA = "check_id int, result_id int, run_id string, started_at timestamp, outcome string"


def random_history(seed, checks=60):
    """Histories of 1 to 40 results, with ties on the time broken by run id."""
    draw = random.Random(seed)
    rows = []
    for check in range(checks):
        for _ in range(draw.randint(1, 40)):
            n = len(rows)
            at = START + timedelta(hours=draw.randint(0, 300))
            rows.append((check, n, f"r{draw.randint(0, 99):02d}{n:05d}", at, draw.choice(WORDS)))
    return rows


def sequential(rows):
    """Each check's head and every event, replayed oldest first."""
    heads, events = {}, {}
    for check, result, run, at, word in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        outcome = word if word in KNOWN else "error"
        h = heads.setdefault(check, {"streak": None, "raw": None, "alert": None, "unskipped": None})
        event = None
        if outcome == "fail" and h["alert"] != "fail":
            event = ("failing", h["alert"])
        elif outcome == "pass" and h["alert"] == "fail":
            event = ("recovered", h["alert"])
        elif outcome == "error" and h["unskipped"] != "error":
            event = ("erroring", h["unskipped"])
        if event:
            events[result] = event
        if outcome in ("pass", "warn", "fail"):
            if not h["streak"] or h["streak"][0] != outcome:
                h["streak"] = (outcome, at)
            h["last"] = at
        if not h["raw"] or h["raw"][0] != outcome:
            h["raw"] = (outcome, at)
        h["alert"] = outcome if outcome in ("pass", "fail") else h["alert"]
        h["unskipped"] = outcome if outcome != "skipped" else h["unskipped"]
        h["head"] = (result, run, at, outcome)
    found = {}
    for check, h in heads.items():
        outcome = h["head"][3]
        if outcome in ("pass", "warn", "fail"):
            tail = (h["streak"][1], None, None, None)
        elif h["streak"]:
            tail = (h["raw"][1], h["streak"][0], h["last"], h["streak"][1])
        else:
            tail = (h["raw"][1], None, None, None)
        found[check] = (*h["head"], *tail, h["alert"], h["unskipped"])
    return found, events


def as_heads(df):
    return {row.check_id: tuple(row)[1:] for row in df.select(*state.HEAD).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_heads_and_changes_replayed(spark, seed):
    rows = random_history(seed)
    wanted, events = sequential(rows)
    history = spark.createDataFrame(rows, SCHEMA)
    assert as_heads(state.current_heads(history)) == wanted
    for hot_rows in (ordered.HOT_ROWS, 7):
        changes = state.state_changes(history, hot_rows=hot_rows).collect()
        assert {r.result_id: (r.event, r.previous_outcome) for r in changes} == events


@pytest.mark.parametrize("seed", range(3))
def test_advancing_equals_recomputing(spark, seed):
    rows = random_history(seed + 100)
    wanted, _ = sequential(rows)
    draw = random.Random(seed)
    history = spark.createDataFrame(rows, SCHEMA)
    # Late results, several results of a check, and checks that are new.
    batch = {r[1] for r in rows if draw.random() < 0.15 or r[0] % 20 == 1}
    newest = {check: head[0] for check, head in wanted.items()}
    batch |= {result for check, result in newest.items() if check % 2 == 0}
    marked = history.withColumn("new", F.col("result_id").isin(*batch))
    heads = state.current_heads(marked.where(~F.col("new")))
    assert as_heads(state.advance_heads(heads, marked.where("new"), history)) == wanted
    before = state.state_changes(marked.where(~F.col("new")))
    after = state.advance_changes(before, heads, marked.where("new"), history).collect()
    events = sequential(rows)[1]
    assert len(after) == len(events)
    assert {r.result_id: (r.event, r.previous_outcome) for r in after} == events


def test_a_batch_of_one_newer_run_does_not_read_the_history(spark):
    rows = [(c, c * 10 + i, f"r{i}", START + timedelta(hours=i), "pass") for c in range(5) for i in range(3)]
    history = spark.createDataFrame(rows, SCHEMA)
    heads = state.current_heads(history.where("run_id < 'r2'"))
    unreadable = history.where(F.raise_error(F.lit("the history was read")).isNotNull())
    moved = state.advance_heads(heads, history.where("run_id = 'r2'"), unreadable)
    assert {h[1] for h in as_heads(moved).values()} == {"r2"}


def test_state_as_of_an_older_run(spark):
    rows = random_history(7)
    at = START + timedelta(hours=120)
    cut = [r for r in rows if (r[3], r[2]) <= (at, "r50")]
    history = spark.createDataFrame(rows, SCHEMA)
    found = state.heads_as_of(history, F.lit(at).cast("timestamp"), F.lit("r50"))
    assert as_heads(found) == sequential(cut)[0]


# --- baselines ---


def measures(seed, clauses=8):
    draw = random.Random(seed)
    rows = []
    for clause in range(clauses):
        for _ in range(draw.randint(30, 260)):
            n = len(rows)
            hours = draw.choice((draw.randint(0, 1000), 24 * draw.randint(0, 40)))
            value = None if draw.random() < 0.2 else float(draw.randint(0, 50))
            rows.append((clause, f"r{n:05d}", START + timedelta(hours=hours), value))
    return rows


def earlier(rows, row):
    """The measured results a run compares with, newest first."""
    return sorted(
        (r for r in rows if r[0] == row[0] and r[2] < row[2] and r[3] is not None),
        key=lambda r: (r[2], r[1]),
        reverse=True,
    )


MEASURES = "clause_id int, run_id string, started_at timestamp, measured double"


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 20])
def test_baselines_of_every_run(spark, hot_rows):
    rows = measures(3)
    history = spark.createDataFrame(rows, MEASURES)
    got = {r.run_id: r for r in change.previous_backfill(history, hot_rows=hot_rows).collect()}
    last = {r.run_id: r for r in change.last_runs_backfill(history, 5, hot_rows).collect()}
    assert set(last) == {r[1] for r in rows if r[3] is not None}
    for row in rows:
        before = earlier(rows, row)
        wanted = before[0] if before else None
        assert got[row[1]].previous == (wanted and wanted[3])
        assert got[row[1]].previous_run == (wanted and wanted[1])
        if row[1] in last:
            mean = sum(r[3] for r in before[:5]) / 5 if len(before) >= 5 else None
            assert last[row[1]].previous == (None if mean is None else pytest.approx(mean))


def weekday_of(rows, row):
    midnight = row[2].replace(hour=0, minute=0)
    limit = midnight - timedelta(days=6)
    readable = [r for r in earlier(rows, row) if r[2] <= limit]
    return next((r for r in readable if r[2].weekday() == row[2].weekday()), None)


def test_same_weekday_of_every_run(spark):
    rows = measures(5)
    # A clause so busy that hundreds of results lie between a day and its weekday before.
    rows += [(99, "early", START, 1.0), (99, "now", START + timedelta(days=21), 3.0)]
    rows += [(99, f"b{i:03d}", START + timedelta(days=15, minutes=i - 1440), 2.0) for i in range(120)]
    history = spark.createDataFrame(rows, MEASURES)
    got = {r.run_id: r for r in change.same_weekday_backfill(history).collect()}
    for row in rows:
        wanted = weekday_of(rows, row)
        assert got[row[1]].previous == (wanted and wanted[3]), row
        assert got[row[1]].previous_run == (wanted and wanted[1]), row


def test_a_read_agrees_with_the_backfill(spark):
    rows = measures(9)
    history = spark.createDataFrame(rows, MEASURES).withColumn("run_key", F.lit(None).cast("string"))
    now = START + timedelta(days=38, hours=5)
    at = F.lit(now).cast("timestamp")
    samples = change.earlier_samples(history, at)
    found = {
        "previous": change.baseline_previous(samples),
        "weekday": change.baseline_same_weekday(samples, at),
        "last": change.baseline_last_runs(samples, 5),
    }
    values = {name: {r.clause_id: r.previous for r in df.collect()} for name, df in found.items()}
    for clause in range(8):
        probe = (clause, "z", now, 0.0)
        before, weekday = earlier(rows, probe), weekday_of(rows, probe)
        assert values["previous"][clause] == before[0][3]
        assert values["weekday"].get(clause) == (weekday and weekday[3])
        assert values["last"][clause] == pytest.approx(sum(r[3] for r in before[:5]) / 5)


def test_runs_under_the_same_key_are_one_run(spark):
    rows = [(1, "a", START, 1.0, None), (1, "b", START + timedelta(hours=1), 2.0, "k")]
    history = spark.createDataFrame(rows, MEASURES + ", run_key string")
    now = F.lit(START + timedelta(days=1)).cast("timestamp")
    previous = change.baseline_previous(change.earlier_samples(history, now, "k"))
    assert previous.first().previous == 1.0


def test_relative_change(spark):
    cases = [(-50.0, -100.0, 50.0), (5.0, 0.0, None), (0.0, 0.0, 0.0), (3.0, 2.0, 50.0)]
    df = spark.createDataFrame(cases, "now double, before double, wanted double")
    got = df.select(change.change_relative(F.col("now"), F.col("before")).alias("c"), "wanted")
    assert all(row.c == row.wanted for row in got.collect())


# --- series and versions, with keys cut and not cut ---


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 5])
def test_running_values_and_numbers(spark, hot_rows):
    draw = random.Random(1)
    rows = [
        (c, START + timedelta(minutes=draw.randint(0, 5000)), f"r{i:04d}", draw.choice([None, 1, 2, 3]))
        for c in range(6)
        for i in range(draw.randint(1, 60))
    ]
    df = spark.createDataFrame(rows, "k int, at timestamp, run string, v int")
    hot = ordered.hot_keys(df, ["k"], "at", hot_rows)
    got = ordered.running(
        df, ["k"], ("at", "run"), newest={"last": F.col("v")}, totals={"sum": F.col("v")}, hot=hot
    )
    got = ordered.numbered(got, ["k"], ("at", "run"), "i", hot).collect()
    for row in got:
        before = sorted((r[1], r[2], r[3]) for r in rows if r[0] == row.k and r[1:3] < (row.at, row.run))
        values = [b[2] for b in before if b[2] is not None]
        assert row.i == len(before) + 1
        assert row.last == (values[-1] if values else None)
        assert row.sum == sum(values)


def test_a_burst_within_one_second_is_cut_by_counts(spark):
    rows = [(1, START + timedelta(microseconds=i), i) for i in range(4000)] + [(2, START, 0)]
    df = spark.createDataFrame(rows, "k int, at timestamp, run int")
    hot = ordered.hot_keys(df, ["k"], "at", 100)
    sizes = ordered.with_spans(df, ["k"], "at", hot, "left").groupBy("k", ordered.SPAN).count()
    got = {(r["k"], r[ordered.SPAN]): r["count"] for r in sizes.collect()}
    assert got.pop((2, 0)) == 1
    assert len(got) == ordered.SPANS and max(got.values()) <= 2 * 4000 / ordered.SPANS


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 4])
def test_versions_and_reverts(spark, hot_rows):
    texts = "a a b b a c c a".split()
    rows = [(1, t, START + timedelta(days=i), f"r{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "check_id int, fingerprint string, started_at timestamp, run_id string")
    versions = lifecycle.definition_versions(df, hot_rows=hot_rows).orderBy("version").collect()
    assert [(v.version, v.fingerprint, v.run_id) for v in versions] == [
        (1, "a", "r0"), (2, "b", "r2"), (3, "a", "r4"), (4, "c", "r5"), (5, "a", "r7"),
    ]


def test_segments_break_at_everything_unplotted(spark):
    values = [1.0, 2.0, None, 3.0, float("nan"), 4.0, 5.0, 6.0]
    outcomes = ["pass"] * 6 + ["error", "pass"]
    rows = [
        (1, START + timedelta(hours=i), f"r{i}", o, v, "avg" if i != 5 else "sum")
        for i, (v, o) in enumerate(zip(values, outcomes, strict=True))
    ]
    df = spark.createDataFrame(
        rows, "check_id int, started_at timestamp, run_id string, outcome string, value double, metric string"
    )
    found = series.value_segments(df, F.lit("avg")).orderBy("breaks").collect()
    assert [(s.points, s.lowest, s.highest) for s in found] == [(2, 1, 2), (1, 3, 3), (1, 6, 6)]


def final_plan(df):
    df = df.agg(F.count(F.lit(1)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_without_hot_keys_a_history_is_read_and_shuffled_once(spark, tmp_path):
    spark.createDataFrame(random_history(1), SCHEMA).write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    plan = final_plan(state.state_changes(history))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_at_most_one_job_runs_before_running_values_are_read(spark, tmp_path):
    spark.createDataFrame(random_history(1), SCHEMA).write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    spark.sparkContext.setJobGroup("building", "state changes")
    state.state_changes(history)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")
    # The stages before the last aggregate may be a job of their own to adaptive execution.
    assert 1 <= len(jobs) <= 3


def test_heads_shuffle_aggregates_alone(spark, tmp_path):
    spark.createDataFrame(random_history(1), SCHEMA).write.parquet(str(tmp_path / "h"))
    plan = final_plan(state.current_heads(spark.read.parquet(str(tmp_path / "h"))))
    assert "SortMergeJoin" not in plan and "Window" not in plan


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 3])
def test_same_weekday_in_one_shuffle_and_of_clauses_cut_in_spans(spark, hot_rows, tmp_path):
    rows = measures(6)
    rows += [(99, f"b{i:03d}", START + timedelta(days=7 * (i % 4), minutes=i), float(i) if i % 3 else None) for i in range(80)]
    spark.createDataFrame(rows, MEASURES).write.parquet(str(tmp_path / "h"))
    found = change.same_weekday_backfill(spark.read.parquet(str(tmp_path / "h")), hot_rows)
    if hot_rows == ordered.HOT_ROWS:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1, plan
    got = {(r.clause_id, r.run_id): r for r in found.collect()}
    assert len(got) == len(rows)
    for row in rows:
        wanted = weekday_of(rows, row)
        assert got[row[0], row[1]].previous == (wanted and wanted[3]), row
        assert got[row[0], row[1]].previous_run == (wanted and wanted[1]), row


def test_keys_are_counted_alone_only_where_many_rows_share_a_hash(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id % 100 as k", "timestamp_seconds(id) as at")
    hot = rows.unionAll(spark.range(50).selectExpr("7L as k", "timestamp_seconds(1000 + id) as at"))
    for groups in (1, 4, ordered.GROUPS):  # keys that share a hash are told apart
        monkeypatch.setattr(ordered, "GROUPS", groups)
        assert ordered.hot_keys(rows, ["k"], "at", 3).cuts is None
        assert [r.k for r in ordered.hot_keys(hot, ["k"], "at", 3).cuts.collect()] == [7]
