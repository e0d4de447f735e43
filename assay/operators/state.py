"""How long each check has been as it is, and when it changed.

A result that says nothing about the data (`error`, `skipped`) neither ends nor
extends a streak of evaluated outcomes. Every function takes results joined to
their runs: `check_id, result_id, run_id, started_at, outcome`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import ALERTING, EVALUATED, SEVERITY, is_evaluated, known_outcome
from assay.operators.ordered import running
from assay.sources.results import settled

ORDER = ("started_at", "run_id")
HEAD = (
    "check_id",
    "result_id",
    "run_id",
    "started_at",
    "outcome",
    "since",
    "last_outcome",
    "last_started_at",
    "last_since",
    "basis_alert",
    "basis_unskipped",
)


def _entries(results: DataFrame) -> DataFrame:
    return results.select(
        "check_id",
        "result_id",
        F.struct(*ORDER).alias("at"),
        known_outcome(F.col("outcome")).alias("outcome"),
    )


def _newest_of(seen: dict[str, Column], outcomes: tuple[str, ...]) -> Column:
    """The newest time any of these outcomes was seen; NULL when none was."""
    times = [seen[word] for word in outcomes]
    return F.greatest(*times) if len(times) > 1 else times[0]


def _named(seen: dict[str, Column], at: Column, outcomes: tuple[str, ...]) -> Column:
    """Which of these outcomes was seen at a time."""
    return F.coalesce(*[F.when(seen[word] == at, F.lit(word)) for word in outcomes])


def current_heads(results: DataFrame) -> DataFrame:
    """Each check's newest result, its streak, and what alerts compare with.

    Two aggregations and no sort by check: the first, run at once, finds when
    each outcome was last seen, which bounds the streaks; the second takes the
    oldest result after that bound. Both combine rows before they shuffle, so
    the work does not depend on how many results one check has.
    """
    entries = _entries(results)
    outcome, at = F.col("outcome"), F.col("at")
    seen = {word: F.col(f"seen_{word}") for word in SEVERITY}
    newest = F.max(F.struct("at", "outcome", "result_id"))
    lasts = [F.max(F.when(outcome == w, at)).alias(f"seen_{w}") for w in SEVERITY]
    marks = entries.groupBy("check_id").agg(newest.alias("top"), *lasts)
    unskipped = tuple(w for w in SEVERITY if w != "skipped")
    marks = marks.select(
        "*",
        F.col("top.outcome").alias("now"),
        _named(seen, _newest_of(seen, EVALUATED), EVALUATED).alias("last"),
        _named(seen, _newest_of(seen, ALERTING), ALERTING).alias("basis_alert"),
        _named(seen, _newest_of(seen, unskipped), unskipped).alias("basis_unskipped"),
    )
    other = {w: F.when(F.col("now") != w, seen[w]) for w in SEVERITY}
    other_evaluated = {w: F.when(F.col("last") != w, seen[w]) for w in EVALUATED}
    marks = marks.withColumns(
        {
            "raw_edge": _newest_of(other, tuple(SEVERITY)),
            "eval_edge": _newest_of(other_evaluated, EVALUATED),
            "last_at": _newest_of(seen, EVALUATED),
        }
    )
    marks = settled(marks.drop(*[f"seen_{w}" for w in SEVERITY]))
    edges = marks.select("check_id", "last", "raw_edge", "eval_edge")
    in_raw = F.col("raw_edge").isNull() | (at > F.col("raw_edge"))
    in_streak = (outcome == F.col("last")) & (
        F.col("eval_edge").isNull() | (at > F.col("eval_edge"))
    )
    starts = (
        entries.select("check_id", "at", "outcome")
        .join(edges, "check_id")
        .where(in_raw | F.coalesce(in_streak, F.lit(False)))
        .groupBy("check_id")
        .agg(
            F.min(F.when(in_raw, F.col("at.started_at"))).alias("raw_since"),
            F.min(F.when(in_streak, F.col("at.started_at"))).alias("eval_since"),
        )
    )
    evaluated = is_evaluated(F.col("now"))
    before = F.when(~evaluated, F.col("last"))
    return marks.join(starts, "check_id").select(
        "check_id",
        F.col("top.result_id").alias("result_id"),
        F.col("top.at.run_id").alias("run_id"),
        F.col("top.at.started_at").alias("started_at"),
        F.col("now").alias("outcome"),
        F.when(evaluated, F.col("eval_since")).otherwise(F.col("raw_since")).alias("since"),
        before.alias("last_outcome"),
        F.when(~evaluated, F.col("last_at.started_at")).alias("last_started_at"),
        F.when(before.isNotNull(), F.col("eval_since")).alias("last_since"),
        "basis_alert",
        "basis_unskipped",
    )


def not_newer_than(started_at: Column, run_id: Column) -> Column:
    """Results of the run at this place in history and of older ones."""
    return F.struct(*ORDER) <= F.struct(started_at.alias("started_at"), run_id.alias("run_id"))


def heads_as_of(results: DataFrame, started_at: Column, run_id: Column) -> DataFrame:
    """`current_heads` as it stood when a run was recorded."""
    return current_heads(results.where(not_newer_than(started_at, run_id)))


def event_of(outcome: Column, alert: Column, unskipped: Column) -> Column:
    """What a result changed, against the newest fail or pass and the newest
    result that was not skipped; NULL when nothing worth telling."""
    return (
        F.when((outcome == "fail") & ~alert.eqNullSafe("fail"), "failing")
        .when((outcome == "pass") & (alert == "fail"), "recovered")
        .when((outcome == "error") & ~unskipped.eqNullSafe("error"), "erroring")
    )


def alert_basis(results: DataFrame, **hot: int) -> DataFrame:
    """Each result with what its check's alerts are compared with before it."""
    outcome = F.col("outcome")
    return running(
        results.withColumn("outcome", known_outcome(outcome)),
        ["check_id"],
        ORDER,
        newest={
            "basis_alert": F.when(outcome.isin(*ALERTING), outcome),
            "basis_unskipped": F.when(outcome != "skipped", outcome),
        },
        **hot,
    )


def state_changes(results: DataFrame, **hot: int) -> DataFrame:
    """Every result that opened, closed or broke an alert, with what came before."""
    outcome = F.col("outcome")
    alert, unskipped = F.col("basis_alert"), F.col("basis_unskipped")
    previous = F.when(outcome == "error", unskipped).otherwise(alert)
    return (
        alert_basis(results, **hot)
        .withColumns(
            {"event": event_of(outcome, alert, unskipped), "previous_outcome": previous}
        )
        .where(F.col("event").isNotNull())
        .drop("basis_alert", "basis_unskipped")
    )


def _against_heads(heads: DataFrame, batch: DataFrame) -> DataFrame:
    """Every head beside the `new` result of its check, in one join, kept.

    `moves`: the check has one new result and that is newer than its head, so the
    head alone tells what follows. `redo`: it is new, or has several new results
    or a late one, and must be recomputed.
    """
    new = _entries(batch).groupBy("check_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "outcome", "result_id")).alias("new")
    )
    at = F.struct(*[F.col(c) for c in ORDER])
    moves = F.coalesce((F.col("n") == 1) & (F.col("new.at") > at), F.lit(False))
    both = heads.select(*HEAD).join(new, "check_id", "full_outer").withColumn("moves", moves)
    return settled(both.withColumn("redo", F.col("n").isNotNull() & ~F.col("moves")))


CHANGE = ("check_id", "result_id", "run_id", "started_at", "event", "previous_outcome")


def advance(
    heads: DataFrame, batch: DataFrame, history: DataFrame, changes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Heads, and state changes if given, after a batch of new results.

    Both equal a full recompute. The `history`, which holds the batch already,
    is read only for checks that must be recomputed, and not at all without any,
    which is the usual case. A late result can change what later ones meant, so
    those checks have all their changes replaced.
    """
    both = _against_heads(heads, batch)
    redo = both.where("redo").select("check_id")
    late = None if redo.isEmpty() else history.join(redo, "check_id", "left_semi")
    moved = both.where("moves")
    heads_now = both.where("n is null").select(*HEAD).unionByName(_moved(moved))
    if late is not None:
        heads_now = heads_now.unionByName(current_heads(late).select(*HEAD))
    if changes is None:
        return heads_now, None

    outcome = F.col("new.outcome")
    alert, unskipped = F.col("basis_alert"), F.col("basis_unskipped")
    told = moved.select(
        "check_id",
        F.col("new.result_id").alias("result_id"),
        F.col("new.at.run_id").alias("run_id"),
        F.col("new.at.started_at").alias("started_at"),
        event_of(outcome, alert, unskipped).alias("event"),
        F.when(outcome == "error", unskipped).otherwise(alert).alias("previous_outcome"),
    )
    kept, added = changes.select(*CHANGE), told.where(F.col("event").isNotNull())
    if late is None:
        return heads_now, kept.unionByName(added)
    again = state_changes(late).select(*CHANGE)
    kept = kept.join(redo, "check_id", "left_anti")
    return heads_now, kept.unionByName(added).unionByName(again)


def advance_heads(heads: DataFrame, batch: DataFrame, history: DataFrame) -> DataFrame:
    """All heads after a batch of new results, see `advance`."""
    return advance(heads, batch, history)[0]


def advance_changes(
    changes: DataFrame, heads: DataFrame, batch: DataFrame, history: DataFrame
) -> DataFrame:
    """All state changes after a batch of new results, see `advance`."""
    return advance(heads, batch, history, changes)[1]


def _moved(both: DataFrame) -> DataFrame:
    """Heads moved on by the one newer result in `new`."""
    was, now = F.col("outcome"), F.col("new.outcome")
    start = F.col("new.at.started_at")
    was_seen, now_seen = is_evaluated(was), is_evaluated(now)
    # What the data last showed before the new result, whatever came between.
    shown = F.when(was_seen, was).otherwise(F.col("last_outcome"))
    shown_since = F.when(was_seen, F.col("since")).otherwise(F.col("last_since"))
    shown_at = F.when(was_seen, F.col("started_at")).otherwise(F.col("last_started_at"))
    goes_on = F.when(now_seen, shown.eqNullSafe(now)).otherwise(was == now)
    went_on = F.when(now_seen, shown_since).otherwise(F.col("since"))
    none = F.lit(None)
    return both.select(
        "check_id",
        F.col("new.result_id").alias("result_id"),
        F.col("new.at.run_id").alias("run_id"),
        start.alias("started_at"),
        now.alias("outcome"),
        F.when(goes_on, went_on).otherwise(start).alias("since"),
        F.when(now_seen, none).otherwise(shown).alias("last_outcome"),
        F.when(now_seen, none).otherwise(shown_at).alias("last_started_at"),
        F.when(now_seen, none).otherwise(shown_since).alias("last_since"),
        F.when(now.isin(*ALERTING), now).otherwise(F.col("basis_alert")).alias("basis_alert"),
        F.when(now != "skipped", now).otherwise(F.col("basis_unskipped")).alias("basis_unskipped"),
    )
