"""A run recorded in one step, and what a dashboard asks of the record.

A `Log` holds the results of one project. Recording a run appends its rows and moves every
table on that is kept so that nobody has to read the history: the heads with what
a list shows of them, the intervals of earlier heads, the state changes, and the samples that
baselines are taken from. All of it becomes visible together. A retry of a dataset within a run
hides the dataset's earlier rows; no stored file is rewritten for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import worst_outcome
from assay.operators import samples, timeline
from assay.operators.judge import run_rollup
from assay.operators.lifecycle import register_on_result
from assay.operators.ordered import newest_row
from assay.operators.resume import answered
from assay.operators.run import RunFrames, run_suites
from assay.operators.state import CHANGE, HEAD, ORDER
from assay.sources.log import AlreadyDone, Conflict, Log, Snapshot
from assay.sources.results import settled, with_day
from assay.spec import Suite

# What a list of checks shows of each one's newest result.
SHOWN = (
    "name", "dataset", "datasource", "owner", "tags", "source", "expression", "metric", "value", "display_value",
    "message",
)
ATTEMPT = ("run_id", "datasource", "dataset")
SAMPLED = (*samples.KEY, *samples.SAMPLE)


def record(
    log: Log,
    run: RunFrames,
    *,
    retry: bool = False,
    stream: tuple[str, int] | None = None,
    recorded_at: datetime | None = None,
) -> Snapshot:
    """Record a run's rows and move heads, intervals, changes, samples and the registry on.

    A check with a result becomes active in the registry. With `retry`, rows of the same run and dataset recorded before are replaced. `stream`
    is a stream's name and the number of its batch, which counts once. When another
    run is recorded meanwhile, what depends on it is worked out again; rows are written once.
    """
    keyed = run.clauses.join(run.runs.select("run_id", "run_key"), "run_id")
    by = ["project", "day"]
    rows = [
        log.write("runs", with_day(run.runs), by),
        log.write("results", with_day(run.results), by),
        log.write("clauses", with_day(keyed), by),
    ]
    new, clauses = log.rows_of(rows[1]), log.rows_of(rows[2])
    now = F.lit(recorded_at or datetime.now(UTC)).cast("timestamp")
    carry = [c for c in SHOWN if c in new.columns]
    while True:
        base = log.snapshot()
        if stream is not None and base.streams.get(stream[0], -1) >= stream[1]:
            raise AlreadyDone(f"batch {stream[1]} of {stream[0]}")
        added = list(rows)
        replaced = new.select(*ATTEMPT).distinct() if retry else None
        earlier, earlier_clauses = history(log, base), stored_clauses(log, base)
        gone = rebuilt = None
        if retry and earlier is not None:
            days = [r["day"] for r in new.select("day").distinct().collect()]  # of one run
            old = earlier.where(F.col("day").isin(*days)).join(replaced, list(ATTEMPT), "left_semi")
            gone = settled(old.select("check_id", *ORDER))
            of_old = earlier_clauses.where(F.col("day").isin(*days)).join(
                old.select("result_id"), "result_id", "left_semi"
            )
            rebuilt = settled(of_old.select("clause_id").distinct())
            earlier = earlier.join(replaced, list(ATTEMPT), "left_anti")
            earlier_clauses = earlier_clauses.join(gone.select("check_id", "run_id"), ["check_id", "run_id"], "left_anti")
            upto = F.lit(base.version).cast("long").alias("upto")
            added.append(log.write("replaced", replaced.select(*ATTEMPT, upto)))
        whole = new if earlier is None else earlier.unionByName(new, allowMissingColumns=True)
        heads, closed = log.read(base, "heads"), intervals(log, base)
        if heads is None:
            heads = new.limit(0).select(*_empty_head(new), *carry)
        if closed is None:
            at, run_id = (F.col(c).alias(n) for c, n in zip(ORDER, timeline.UNTIL, strict=True))
            closed = heads.limit(0).select("*", at, run_id)
        if retry:
            added.append(log.write("runs", _whole_runs(whole, run.runs), by))
        known = log.read(base, "registry")
        if known is None:
            nothing = F.lit(None).cast("string").alias("state"), now.alias("state_since")
            known = new.limit(0).select("check_id", "name", "dataset", "datasource", *nothing)
        registry = register_on_result(known, new, now)
        moved = timeline.advance(heads, closed, new, whole, carry, gone)
        added.append(log.write("closed", timeline.binned(moved.closed), ["bin"]))
        added.append(log.write("changes", moved.changes))
        if moved.late is not None:
            upto = F.lit(base.version).cast("long").alias("upto")
            added.append(log.write("redone", moved.late.select("*", upto)))
        held = log.read(base, "samples")
        every = clauses if earlier_clauses is None else earlier_clauses.unionByName(clauses, allowMissingColumns=True)
        if held is None:
            held = samples.newest_samples(clauses)
        else:
            held = samples.advance_samples(held, clauses, rebuilt, every)
        try:
            kept = {"heads": moved.heads, "samples": held, "registry": registry}
            return log.commit(base, added, [log.write(n, df) for n, df in kept.items()], stream)
        except Conflict:
            continue


def _whole_runs(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of retried runs, over the results of all their attempts."""
    of_run = results.join(runs.select("run_id"), "run_id", "left_semi")
    totals = run_rollup(of_run, "run_id", "position")
    counts = {"passed": "pass", "warned": "warn", "failed": "fail", "errored": "error"}
    whole = totals.select("run_id", "outcome", "exit_code", "total", *[F.col(c).alias(n) for n, c in counts.items()])
    rest = [c for c in runs.columns if c == "run_id" or c not in whole.columns]
    return with_day(runs.select(*rest).join(whole, "run_id").select(*runs.columns))


def runs(log: Log, snapshot: Snapshot | None = None) -> DataFrame | None:
    """The recorded runs, each as its last attempt left it."""
    rows = log.read(snapshot or log.snapshot(), "runs", versions=True)
    if rows is None:
        return None
    return newest_row(rows, ["run_id"], ["version", "total"]).drop("version")


def _empty_head(results: DataFrame) -> list[Column]:
    kinds = {name: results.schema["started_at"].dataType for name in ("since", "last_started_at", "last_since")}
    return [
        F.col(c) if c in results.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in HEAD
    ]


def _without(rows: DataFrame, hidden: DataFrame | None, keys: Sequence[str], held: Column) -> DataFrame:
    """Rows that no row of `hidden` with their keys hides: those where `held`, or that came later."""
    if hidden is None:
        return rows
    both = rows.join(settled(hidden), list(keys), "left")
    lasting = F.col("upto").isNull() | (F.col("version") > F.col("upto")) | held
    return both.where(lasting).select(*rows.columns)


def history(log: Log, snapshot: Snapshot) -> DataFrame | None:
    """All results that count, those of replaced attempts left out."""
    hidden = log.read(snapshot, "replaced")
    rows = log.read(snapshot, "results", versions=hidden is not None)
    if rows is None or hidden is None:
        return rows
    newest = hidden.groupBy(*ATTEMPT).agg(F.max("upto").alias("upto"))
    return _without(rows, newest, ATTEMPT, F.lit(False)).drop("version")


def stored_clauses(log: Log, snapshot: Snapshot) -> DataFrame | None:
    """All clause results that count."""
    hidden = log.read(snapshot, "replaced")
    rows = log.read(snapshot, "clauses", versions=hidden is not None)
    if rows is None or hidden is None:
        return rows
    # A clause result belongs to the attempt of its check.
    attempts = log.read(snapshot, "results").select("check_id", *ATTEMPT)
    newest = hidden.groupBy(*ATTEMPT).agg(F.max("upto").alias("upto"))
    of_check = attempts.join(newest, list(ATTEMPT)).groupBy("check_id", "run_id").agg(F.max("upto").alias("upto"))
    return _without(rows, of_check, ["check_id", "run_id"], F.lit(False)).drop("version")


def _redone(log: Log, snapshot: Snapshot, table: str, at: str, run: str) -> DataFrame | None:
    hidden = log.read(snapshot, "redone")
    rows = log.read(snapshot, table, versions=hidden is not None)
    if rows is None or hidden is None:
        return rows
    # A row is hidden by any late result at or before its end that came after it.
    place = F.struct(F.col("first_at").alias("a"), F.col("first_run").alias("b"))
    late = hidden.select("check_id", place.alias("place"), "upto")
    here = F.struct(F.col(at).alias("a"), F.col(run).alias("b"))
    of_check = late.groupBy("check_id").agg(F.collect_list(F.struct("place", "upto")).alias("late"))
    both = rows.join(settled(of_check), "check_id", "left")
    hides = F.exists("late", lambda x: (x["place"] <= here) & (x["upto"] >= F.col("version")))
    return both.where(~F.coalesce(hides, F.lit(False))).drop("late", "version")


def intervals(log: Log, snapshot: Snapshot) -> DataFrame | None:
    """The intervals of earlier heads, with their `bin`."""
    return _redone(log, snapshot, "closed", *timeline.UNTIL)


def changes(log: Log, snapshot: Snapshot | None = None) -> DataFrame | None:
    """The state changes of all checks."""
    found = _redone(log, snapshot or log.snapshot(), "changes", *ORDER)
    return None if found is None else found.select(*CHANGE)


def overview(log: Log, snapshot: Snapshot | None = None) -> DataFrame | None:
    """Every check's head with what a list shows of it: one small table, no result."""
    return log.read(snapshot or log.snapshot(), "heads")


def state_as_of(log: Log, started_at: datetime, run_id: str, snapshot: Snapshot | None = None) -> DataFrame:
    """Every check's head as of a run, from heads and the intervals around it."""
    snapshot = snapshot or log.snapshot()
    return timeline.as_of(log.read(snapshot, "heads"), intervals(log, snapshot), started_at, run_id)


def baselines(
    log: Log, suites: Sequence[Suite], now: datetime, run_key: str | None = None
) -> DataFrame | None:
    """What a run at `now` compares the suites' `change` clauses with; None before the first run."""
    snapshot = log.snapshot()
    held = log.read(snapshot, "samples")
    if held is None:
        return None
    at = F.lit(now).cast("timestamp")
    every = stored_clauses(log, snapshot)
    return samples.stored_baselines(held, samples.wanted_of(log.spark, suites), at, run_key, every)


def run_recorded(
    log: Log,
    suites: Sequence[tuple[Suite, DataFrame]],
    now: datetime,
    *,
    project: str,
    run_id: str | None = None,
    run_key: str | None = None,
    retry: bool = False,
    stream: tuple[str, int] | None = None,
) -> Snapshot:
    """Measure suites against their baselines and record the run.

    A `run_key` names one logical run. If one with that key was recorded before, this goes on
    with it: datasets it has an answer for are not measured again, those in error are and
    replace what was recorded of them, and with nothing left to do nothing is recorded.
    """
    earlier = None if run_key is None else _attempted(log, project, run_key)
    if earlier is not None:
        run_id, now, retry, done = *earlier[:2], True, earlier[2]
        suites = [(s, df) for s, df in suites if (s.datasource, s.dataset) not in done]
        if not suites:
            return log.snapshot()
    known = baselines(log, [suite for suite, _ in suites], now, run_key)
    run = run_suites(suites, now, project=project, run_id=run_id, run_key=run_key, baselines=known)
    return record(log, run, retry=retry, stream=stream)


def _attempted(log: Log, project: str, run_key: str) -> tuple[str, datetime, set] | None:
    """The run recorded under a key: its id, its start, and the datasets it has an answer for."""
    snapshot = log.snapshot()
    rows = runs(log, snapshot)
    if rows is None:
        return None
    of_key = rows.where((F.col("project") == project) & (F.col("run_key") == run_key))
    newest = of_key.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).first()
    if newest is None:
        return None
    results = history(log, snapshot).where((F.col("day") == F.lit(newest["day"])) & (F.col("run_id") == newest["run_id"]))
    told = results.groupBy(*ATTEMPT).agg(worst_outcome(F.col("outcome")).alias("outcome"))
    done = {(r["datasource"], r["dataset"]) for r in answered(told).collect()}  # of one run
    return newest["run_id"], newest["started_at"], done


def each_batch(
    log: Log, suite: Suite, name: str, project: str, now: Callable[[int], datetime]
) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: every batch of a stream is a run of the suite.

    A batch that the stream gives again after a stop is the same run and counts once.
    `now` says when the run of a batch started.
    """

    def run(rows: DataFrame, batch: int) -> None:
        if log.snapshot().streams.get(name, -1) >= batch:
            return
        try:
            run_recorded(
                log, [(suite, rows)], now(batch), project=project, run_id=f"{name}-{batch:09d}", stream=(name, batch)
            )
        except AlreadyDone:
            pass  # another driver was faster with the same batch

    return run
