"""Runs recorded through the log: what is kept equals what the history says."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay.functions.rows import literal_rows
from assay.operators import record, samples, state, timeline
from assay.operators.run import RunFrames, run_suites
from assay.sources.log import AlreadyDone, Conflict, Log
from assay.sources.results import shared_folder
from assay.spec import Change, Check, Clause, Rule, Suite

START = datetime(2024, 3, 1)


@pytest.fixture
def log(spark):
    return Log(spark, shared_folder(spark))


def suite(dataset="db.t", *more):
    clause = Clause("row_count", expect=Rule(">", 2))
    steady = Clause("row_count", expect=Rule("between", -1, 1), change=Change())
    return Suite(dataset, [Check("has rows", [clause]), Check("steady", [steady]), *more], owner="me", tags=("a", "b"))


def rows(spark, n):
    return spark.range(n)


def run(log, n, day, **options):
    options = {"project": "p", "run_id": f"r{day:02d}"} | options
    return record.run_recorded(log, [(suite(), rows(log.spark, n))], START + timedelta(days=day), **options)


def recomputed(log):
    found = record.history(log, log.snapshot()).select("check_id", "result_id", "run_id", "started_at", "outcome")
    return sorted(map(tuple, state.current_heads(found).collect())), sorted(map(tuple, state.state_changes(found).select(*state.CHANGE).collect()))


def stored(log):
    heads = sorted(map(tuple, record.overview(log).select(*state.HEAD).collect()))
    return heads, sorted(map(tuple, record.changes(log).collect()))


def test_recorded_runs_keep_heads_changes_and_baselines(log):
    for day, n in ((0, 5), (3, 4), (2, 7)):  # the last one late
        run(log, n, day)
        assert stored(log) == recomputed(log)
    shown = {r["name"]: r for r in record.overview(log).collect()}
    assert shown["has rows"].value == 4.0 and shown["has rows"].tags == ["a", "b"] and shown["has rows"].owner == "me"
    assert shown["steady"].outcome == "pass"  # 4 rows after 5
    snapshot = log.snapshot()
    found = record.history(log, snapshot)
    for at, run_id in ((START + timedelta(days=d, hours=h), f"r{d:02d}") for d in (0, 2, 3) for h in (0, 5)):
        want = state.heads_as_of(found, F.lit(at).cast("timestamp"), F.lit(run_id)).select(*state.HEAD)
        got = record.state_as_of(log, at, run_id).select(*state.HEAD)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_overview_reads_no_result_file(log):
    run(log, 5, 0)
    run(log, 5, 1)
    files = record.overview(log).inputFiles()
    assert files and all("/heads/" in f for f in files)
    plan = record.overview(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    of_run = record.baselines(log, [suite()], START + timedelta(days=2))
    assert [r.previous for r in of_run.collect()] == [5.0]


def test_a_retry_replaces_its_dataset_and_rewrites_nothing(log):
    for day, n in ((0, 5), (1, 1)):
        run(log, n, day)
    before = log.snapshot()
    files = set(record.history(log, before).inputFiles())
    run(log, 6, 1, retry=True)
    after = log.snapshot()
    assert files <= set(record.history(log, after).inputFiles())
    found = {(r["run_id"], r["name"]): r["value"] for r in record.history(log, after).collect()}
    assert found["r01", "has rows"] == 6.0 and len(found) == 4
    assert stored(log) == recomputed(log)
    table = log.read(after, "samples")
    want = samples.newest_samples(record.stored_clauses(log, after))
    assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))
    # A reader of the older state still sees it.
    assert {r["value"] for r in record.history(log, before).where("run_id = 'r01' and name = 'has rows'").collect()} == {1.0}


def test_a_retry_without_a_check_forgets_its_result(log):
    extra = Check("extra", [Clause("row_count", expect=Rule(">", 100))])
    spark = log.spark
    for day in (0, 1):
        record.run_recorded(log, [(suite("db.t", extra), rows(spark, 5))], START + timedelta(days=day), project="p", run_id=f"r{day:02d}")
    run(log, 5, 1, retry=True)
    assert stored(log) == recomputed(log)
    head = record.overview(log).where("name = 'extra'").first()
    assert (head.run_id, head.outcome) == ("r00", "fail")


def test_a_stopped_write_shows_the_old_state(log, monkeypatch):
    run(log, 5, 0)
    want, version = stored(log), log.version()
    written = Log.write

    def stops(self, table, rows, by=()):
        if table == "samples":
            raise RuntimeError("stopped")
        return written(self, table, rows, by)

    monkeypatch.setattr(Log, "write", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        run(log, 1, 1)
    monkeypatch.undo()
    assert stored(log) == want == recomputed(log) and log.version() == version
    run(log, 1, 1)
    assert stored(log) == recomputed(log) and len(record.history(log, log.snapshot()).collect()) == 4


def test_writers_at_once_lose_nothing(log):
    run(log, 5, 0)
    problems = []

    def write(day):
        try:
            run(log, 3 + day, day)
        except Exception as problem:  # noqa: BLE001
            problems.append(problem)

    threads = [threading.Thread(target=write, args=(day,)) for day in (1, 2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not problems and log.version() == 3
    assert stored(log) == recomputed(log)
    assert len({r["run_id"] for r in record.history(log, log.snapshot()).collect()}) == 3


def test_numbers_are_given_once_and_replacing_what_changed_is_a_conflict(log):
    spark = log.spark
    first = log.commit(log.snapshot(), [log.write("t", literal_rows(spark, "a int", [(1,)]))])
    two, three = (log.write("t", literal_rows(spark, "a int", [(n,)])) for n in (2, 3))
    log.commit(first, [two])
    with pytest.raises(Conflict):
        log.commit(first, replaced=[three])
    log.commit(first, [log.write("t", literal_rows(spark, "a int, b string", [(4, "x")]))])
    assert log.version() == 3
    assert sorted((r.a, r.b) for r in log.read(log.snapshot(), "t").collect()) == [(1, None), (2, None), (4, "x")]
    assert not log._put(log._manifest(3), "{}")
    log.compact("t")
    assert len(log.snapshot().tables["t"]) == 1 and log.read(log.snapshot(), "t").count() == 3
    assert [r.a for r in log.read(log.snapshot(1), "t").collect()] == [1]
    assert log.read(log.snapshot(), "none") is None


def test_a_stream_given_again_counts_once(log, tmp_path):
    spark = log.spark
    for n, size in enumerate((5, 1, 4)):
        rows(spark, size).write.parquet(str(tmp_path / f"in/{n}"))

    def start(each, checkpoint):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in/*"))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / checkpoint))

    each = record.each_batch(log, suite(), "orders", "p", lambda batch: START + timedelta(hours=batch))
    start(each, "a").trigger(availableNow=True).start().awaitTermination()
    want = stored(log)
    assert want == recomputed(log)
    # The stream lost its place and gives the same batch again.
    start(each, "b").trigger(availableNow=True).start().awaitTermination()
    assert stored(log) == want and log.snapshot().streams == {"orders": 0}
    each(rows(spark, 9), 1)
    each(rows(spark, 9), 1)
    assert log.snapshot().streams == {"orders": 1} and len(record.history(log, log.snapshot()).collect()) == 4
    with pytest.raises(AlreadyDone):
        log.commit(log.snapshot(), stream=("orders", 1))


def test_frames_of_several_runs_are_recorded_at_once(log):
    made = [run_suites([(suite(), rows(log.spark, n))], START + timedelta(days=d), project="p", run_id=f"r{d}") for d, n in ((0, 1), (1, 5), (2, 6))]
    both = RunFrames(*[made[0].__dict__[k].unionByName(made[1].__dict__[k]).unionByName(made[2].__dict__[k]) for k in ("runs", "results", "clauses")])
    record.record(log, both)
    assert stored(log) == recomputed(log)
    assert record.intervals(log, log.snapshot()).count() == 4
    assert timeline.UNTIL[0] in record.intervals(log, log.snapshot()).columns


def test_a_run_key_goes_on_with_its_run(log):
    spark = log.spark
    broken = suite("db.u", Check("broken", [Clause("failed_rows", options={"condition": "1 / (id - id) > 0"})]))
    both = [(suite(), rows(spark, 5)), (broken, rows(spark, 5))]
    record.run_recorded(log, both, START, project="p", run_key="k")
    (first,) = record.runs(log).collect()
    assert (first.outcome, first.exit_code, first.total, first.errored) == ("error", 2, 5, 1)
    unreadable = rows(spark, 5).where(F.raise_error(F.lit("measured again")).isNotNull())
    mended = suite("db.u", Check("broken", [Clause("failed_rows", options={"condition": "id < 0"})]))
    later = START + timedelta(hours=3)
    record.run_recorded(log, [(suite(), unreadable), (mended, rows(spark, 5))], later, project="p", run_key="k")
    (run,) = record.runs(log).collect()
    assert (run.run_id, run.started_at, run.exit_code, run.total, run.errored) == (first.run_id, START, 0, 5, 0)
    assert len(record.history(log, log.snapshot()).collect()) == 5 and stored(log) == recomputed(log)
    version = log.version()
    record.run_recorded(log, [(suite(), unreadable), (mended, unreadable)], later, project="p", run_key="k")
    assert log.version() == version
    registry = log.read(log.snapshot(), "registry").collect()
    assert len(registry) == 5 and {r.state for r in registry} == {"active"}
