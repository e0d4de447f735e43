"""Every state a check has been in, as intervals between its results.

A result gives its check a head, which holds until the check's next result. The head
that still holds is the check's current one; a head that has ended is a closed
interval, from its own place in history (start of the run, run id) to that of the result
which ended it. Intervals answer what the state was as of any run by a lookup, and a
late result by replaying the results after it, not the whole history.

`HEAD` columns are those of `state`; a result may carry further columns (its value, its
message) into its head, for lists that read heads alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import ALERTING, is_evaluated, known_outcome
from assay.functions.times import day_number
from assay.operators.ordered import HOT_ROWS, NONE_HOT, followed, hot_keys, running
from assay.operators.state import CHANGE, HEAD, ORDER, event_of
from assay.sources.results import settled

UNTIL = ("until_at", "until_run")
# Days are counted from the year 0, so that none is negative; the largest bin has 2**MOST_LEVELS,
# which reach to the year 2870.
YEAR_ZERO = 719_528
MOST_LEVELS = 20


def replayed(
    results: DataFrame,
    seeds: DataFrame | None = None,
    carry: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """A row per result: the head it gave its check, its event, and `UNTIL` where it held; NULL if it still does.

    `seeds` are heads that were there before the first of the results; they are among the
    rows, without an event. A check without one starts with its first result. All is one shuffle
    and one sort by check, unless a check has more than `hot_rows` results; None says that none has.
    """
    rest = ["check_id", "result_id", *ORDER]
    outcome, seeded = F.col("outcome"), F.col("_seed")
    rows = results.select(*rest, known_outcome(outcome).alias("outcome"), *carry)
    rows = rows.withColumn("_seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(
            seeds.select(*HEAD, *carry).withColumn("_seed", F.lit(True)), allowMissingColumns=True
        )
    else:
        missing = [c for c in HEAD if c not in rows.columns]
        kinds = {"since": "started_at", "last_started_at": "started_at", "last_since": "started_at"}
        nulls = {
            c: F.lit(None).cast(rows.schema[kinds[c]].dataType if c in kinds else "string")
            for c in missing
        }
        rows = rows.withColumns(nulls)
    hot = NONE_HOT if hot_rows is None else hot_keys(rows, ["check_id"], "started_at", hot_rows)

    def passed(df: DataFrame, inclusive: bool, **newest: Column) -> DataFrame:
        return running(
            df, ["check_id"], ORDER, newest=newest, inclusive=inclusive, hot=hot
        ).drop("_span")

    evaluated = is_evaluated(outcome)
    # A seed's streak of evaluated outcomes, whether its own outcome is part of it or came after.
    shown = F.when(evaluated, outcome).otherwise(F.col("last_outcome"))
    shown_at = F.when(evaluated, F.col("started_at")).otherwise(F.col("last_started_at"))
    shown_since = F.when(evaluated, F.col("since")).otherwise(F.col("last_since"))
    alert, unskipped = F.col("basis_alert"), F.col("basis_unskipped")
    alerting, counted = outcome.isin(*ALERTING), outcome != "skipped"

    at = F.col("started_at")
    before = passed(
        followed(rows, ["check_id"], ORDER, UNTIL, hot),
        False,
        _shown=F.when(seeded, shown).when(evaluated, outcome),
        _shown_at=F.when(seeded, shown_at).when(evaluated, at),
        _outcome=outcome,
        _alert=F.when(seeded, alert).when(alerting, outcome),
        _unskipped=F.when(seeded, unskipped).when(counted, outcome),
    )
    starts = evaluated & ~outcome.eqNullSafe(F.col("_shown"))
    turns = ~outcome.eqNullSafe(F.col("_outcome"))
    after = passed(
        before,
        True,
        _shown_since=F.when(seeded, shown_since).when(starts, at),
        _raw_since=F.when(seeded, F.when(~evaluated, F.col("since"))).when(turns, at),
    )
    head = {
        "since": F.when(evaluated, F.col("_shown_since")).otherwise(F.col("_raw_since")),
        "last_outcome": F.when(~evaluated, F.col("_shown")),
        "last_started_at": F.when(~evaluated, F.col("_shown_at")),
        "last_since": F.when(~evaluated, F.col("_shown_since")),
        "basis_alert": F.when(alerting, outcome).otherwise(F.col("_alert")),
        "basis_unskipped": F.when(counted, outcome).otherwise(F.col("_unskipped")),
    }
    event = event_of(outcome, F.col("_alert"), F.col("_unskipped"))
    return after.select(
        *[c for c in HEAD if c not in head],
        *[F.when(seeded, F.col(name)).otherwise(value).alias(name) for name, value in head.items()],
        *carry,
        F.when(~seeded, event).alias("event"),
        F.when(outcome == "error", F.col("_unskipped")).otherwise(F.col("_alert")).alias(
            "previous_outcome"
        ),
        *UNTIL,
    )


def heads_of(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The head each check has after `replayed` rows."""
    return rows.where(F.col(UNTIL[1]).isNull()).select(*HEAD, *carry)


def closed_of(rows: DataFrame) -> DataFrame:
    """The intervals that `replayed` rows ended."""
    return rows.where(F.col(UNTIL[1]).isNotNull()).drop("event", "previous_outcome")


def changes_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("event").isNotNull()).select(*CHANGE)


# Lookups


def bin_of(start: Column, end: Column, dtype) -> Column:
    """The bin of an interval: the smallest range of 1, 2, 4, ... days that holds both its ends.

    Ranges of one size lie side by side, so a day lies in one of each size, and a
    table partitioned by bin is asked about a day in `MOST_LEVELS` + 1 partitions.
    """
    first, last = (day_number(x, dtype) + YEAR_ZERO for x in (start, end))
    apart = first.bitwiseXOR(last)
    level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))).cast("int")
    slot = F.call_function("shiftright", first, level)
    return F.concat_ws("-", level.cast("string"), slot.cast("string"))


def bins_at(day: int) -> list[str]:
    """The bins an interval over a day, counted from 1970-01-01, can lie in."""
    return [f"{level}-{(day + YEAR_ZERO) >> level}" for level in range(MOST_LEVELS + 1)]


def binned(closed: DataFrame) -> DataFrame:
    """Closed intervals with their `bin`, to be stored partitioned by it."""
    dtype = closed.schema["started_at"].dataType
    return closed.withColumn("bin", bin_of(F.col("started_at"), F.col(UNTIL[0]), dtype))


def as_of(heads: DataFrame, closed: DataFrame, started_at: datetime, run_id: str) -> DataFrame:
    """Each check's head as it stood when the run at a place in history was recorded.

    `heads` hold now, `closed` held earlier. Of stored intervals with a `bin` only
    the partitions that can hold the place are read. No result is read.
    """
    if "bin" in closed.columns:
        wall = started_at.astimezone(UTC).replace(tzinfo=None) if started_at.tzinfo else started_at
        day = (wall - datetime(1970, 1, 1)).days
        closed = closed.where(F.col("bin").isin(*bins_at(day)))
    kind = heads.schema["started_at"].dataType
    at, run = F.lit(started_at).cast(kind), F.lit(run_id)
    begun = (F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("run_id") <= run))
    ended = (F.col(UNTIL[0]) < at) | ((F.col(UNTIL[0]) == at) & (F.col(UNTIL[1]) <= run))
    held = closed.where(begun & ~ended)
    both = [c for c in heads.columns if c in closed.columns]
    return heads.where(begun).select(*both).unionByName(held.select(*both))


# Moving on


@dataclass(frozen=True)
class Moved:
    """What a batch of results does to the stored heads, intervals and changes.

    `heads`: of all checks. `closed`, `changes`: rows to add. `late`: `check_id,
    first_at, first_run` of checks whose stored intervals that end at or after that
    place, and changes from it on, no longer hold; None when there are none.
    """

    heads: DataFrame
    closed: DataFrame
    changes: DataFrame
    late: DataFrame | None


def advance(
    heads: DataFrame,
    closed: DataFrame,
    batch: DataFrame,
    history: DataFrame,
    carry: Sequence[str] = (),
    gone: DataFrame | None = None,
) -> Moved:
    """Heads, intervals and changes after a batch of new results; equal to replaying everything.

    A check whose new results are newer than its head goes on from the head. One with
    a late result goes on from the newest interval before it, over the results from
    there on: of the `history`, which holds the batch already, those of late checks
    from their first late place are read, and nothing if no result is late. `gone` holds
    `check_id, started_at, run_id` of results that the history had and no longer has.
    """
    first = F.min(F.struct(*ORDER)).alias("first")
    at = F.struct(*[F.col(c) for c in ORDER])
    held = heads.select(*HEAD, *carry)
    places = batch.select("check_id", *ORDER)
    if gone is not None:
        places = places.unionByName(gone.select("check_id", *ORDER))
    starts = places.groupBy("check_id").agg(first)
    both = settled(held.join(starts, "check_id", "full_outer"))
    # A right side alone is a new check: it has no seed.
    known = F.col("run_id").isNotNull()
    late = both.where(known & F.col("first").isNotNull() & (F.col("first") <= at))
    late = settled(
        late.select("check_id", F.col("first.started_at").alias("first_at"), F.col("first.run_id").alias("first_run"))
    )
    seeds = both.where(known & (F.col("first") > at)).select(*HEAD, *carry)
    columns = ["check_id", "result_id", *ORDER, "outcome", *carry]
    suffix = batch.select(*columns)
    lowest = late.agg(F.min("first_at")).first()[0]
    if lowest is not None:
        suffix = suffix.join(late, "check_id", "left_anti").unionByName(
            _from_late_on(history, late, lowest).select(*columns)
        )
        place = F.struct(F.col("first_at").alias("started_at"), F.col("first_run").alias("run_id"))
        until = F.struct(F.col(UNTIL[0]).alias("started_at"), F.col(UNTIL[1]).alias("run_id"))
        around = closed.join(late, "check_id").where((at < place) & (until >= place))
        # Written out, since all of the stored intervals are read for them.
        seeds = settled(seeds.unionByName(around.select(*HEAD, *carry)))
    rows = replayed(suffix, seeds, carry, hot_rows=HOT_ROWS if lowest is not None else None)
    rows = settled(rows)
    unmoved = both.where(F.col("first").isNull()).select(*HEAD, *carry)
    # A seed after which nothing is left holds again.
    return Moved(
        unmoved.unionByName(heads_of(rows, carry)),
        closed_of(rows),
        changes_of(rows),
        late if lowest is not None else None,
    )


def _from_late_on(history: DataFrame, late: DataFrame, lowest: datetime) -> DataFrame:
    """Results of late checks from their first late place on; older days are not read."""
    kind = history.schema["started_at"].dataType
    rows = history.where(F.col("started_at") >= F.lit(lowest).cast(kind))
    if "day" in history.columns:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(lowest).cast(kind)))
    after = (F.col("started_at") > F.col("first_at")) | (
        (F.col("started_at") == F.col("first_at")) & (F.col("run_id") >= F.col("first_run"))
    )
    return rows.join(late, "check_id").where(after)


def still_closed(closed: DataFrame, late: DataFrame | None) -> DataFrame:
    """Stored intervals without those that late results ended otherwise."""
    return _without(closed, late, *UNTIL)


def still_changes(changes: DataFrame, late: DataFrame | None) -> DataFrame:
    """Stored changes without those at or after a late result."""
    return _without(changes, late, *ORDER)


def _without(rows: DataFrame, late: DataFrame | None, at: str, run: str) -> DataFrame:
    if late is None:
        return rows
    lasting = F.col("first_at").isNull() | (
        F.struct(F.col(at).alias("a"), F.col(run).alias("b"))
        < F.struct(F.col("first_at").alias("a"), F.col("first_run").alias("b"))
    )
    return rows.join(late, "check_id", "left").where(lasting).drop("first_at", "first_run")
