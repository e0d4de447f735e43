"""Change over time: what a clause's value is compared with, and the change.

`baseline_*` reads what one run at `now` compares with. `*_backfill` gives every
result of a history the baseline its own run had, in one pass. Both take clause
results joined to runs: `clause_id, metric, measured, started_at, run_id` and,
for a read, `run_key`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.rows import literal_rows
from assay.functions.text import format_value
from assay.functions.times import day_number
from assay.operators.judge import message_of, noun, outcome_of
from assay.operators.ordered import (
    HOT_ROWS,
    SPAN,
    hot_keys,
    newest_per_key,
    newest_row,
    running,
    with_spans,
)
from assay.spec import Change, Suite

ORDER = ("started_at", "run_id")
# Fixed value: the days that lie between a day and the same weekday before it.
WEEKDAY_GAP_DAYS = 6


def earlier_samples(
    history: DataFrame, now: Column, run_key: str | None = None
) -> DataFrame:
    """Measured values of runs before `now`, without other attempts at one run."""
    rows = history.where((F.col("started_at") < now) & F.col("measured").isNotNull())
    return rows if run_key is None else exclude_run_key(rows, run_key)


def exclude_run_key(rows: DataFrame, run_key: str) -> DataFrame:
    """Rows of runs that are not attempts at the logical run with this key."""
    return rows.where(F.col("run_key").isNull() | (F.col("run_key") != run_key))


def baseline_previous(samples: DataFrame) -> DataFrame:
    """Each clause's newest earlier sample."""
    newest = newest_row(samples, ["clause_id"], ORDER)
    return newest.select("clause_id", F.col("measured").alias("previous"), *ORDER)


def baseline_same_weekday(samples: DataFrame, now: Column) -> DataFrame:
    """Each clause's newest sample of the same UTC weekday at least 6 days back."""
    dtype = samples.schema["started_at"].dataType
    day, today = day_number(F.col("started_at"), dtype), day_number(now, dtype)
    limit = F.date_trunc("day", now) - F.make_dt_interval(days=F.lit(WEEKDAY_GAP_DAYS))
    old = samples.where(F.col("started_at") <= limit.cast(dtype))
    return baseline_previous(old.where(F.pmod(today - day, F.lit(7)) == 0))


def baseline_last_runs(samples: DataFrame, runs: int) -> DataFrame:
    """The mean of each clause's newest samples; `samples` tells how many there were."""
    ranked = newest_per_key(samples, ["clause_id"], ORDER, runs)
    return ranked.groupBy("clause_id").agg(
        F.when(F.count(F.lit(1)) == runs, F.sum(F.col("measured") / runs)).alias("previous"),
        F.count(F.lit(1)).alias("samples"),
        F.min("started_at").alias("oldest"),
        F.max_by("run_id", F.struct(*ORDER)).alias("run_id"),
        F.max("started_at").alias("started_at"),
    )


def baselines_for(
    history: DataFrame, suites: Sequence[Suite], now: Column, run_key: str | None = None
) -> DataFrame:
    """`clause_id` and `PREVIOUS` for every `change` clause of the suites, read once
    before a run at `now`. Only values of the clause's own metric count."""
    samples = earlier_samples(history, now, run_key)
    wanted: dict[Change, list[Column]] = {}
    for suite in suites:
        for clause_id, _, clause in suite.clause_ids():
            if clause.change is not None:
                of_clause = (F.col("clause_id") == clause_id) & (F.col("metric") == clause.metric)
                wanted.setdefault(clause.change, []).append(of_clause)
    parts = []
    for kind, conditions in wanted.items():
        rows = samples.where(reduce(or_, conditions))
        if kind.baseline == "previous run":
            found = baseline_previous(rows)
        elif kind.baseline == "same weekday":
            found = baseline_same_weekday(rows, now)
        else:
            found = baseline_last_runs(rows, kind.runs).where(F.col("previous").isNotNull())
        if "samples" not in found.columns:
            found = found.withColumns({"samples": F.lit(1).cast("long"), "oldest": F.col("started_at")})
        at, run_id = F.col("started_at").alias("previous_at"), F.col("run_id").alias("previous_run")
        parts.append(found.select("clause_id", "previous", at, run_id, "samples", "oldest"))
    if not parts:
        return literal_rows(history.sparkSession, NO_BASELINES, [])
    return reduce(DataFrame.unionByName, parts)


def previous_backfill(history: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every result with its baseline of the previous run, `previous`."""
    sample = F.struct(F.col("measured").alias("value"), *ORDER)
    found = running(
        history,
        ["clause_id"],
        ORDER,
        newest={"_before": F.when(F.col("measured").isNotNull(), sample)},
        hot=hot_keys(history, ["clause_id"], "started_at", hot_rows),
    )
    before = _first_of_time(F.col("_before"))
    return found.withColumn("_before", before).select(
        *history.columns,
        F.col("_before.value").alias("previous"),
        F.col("_before.started_at").alias("previous_at"),
        F.col("_before.run_id").alias("previous_run"),
    )


def _first_of_time(value: Column) -> Column:
    """What the first result of a clause at one time sees: a baseline starts
    strictly earlier, so results at the same time share it. They lie in one
    span, so the rows stay where they are."""
    same = Window.partitionBy("clause_id", SPAN, "started_at").orderBy("run_id")
    return F.first(value).over(same)


def last_runs_backfill(history: DataFrame, runs: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every measured result with the mean of the `runs` before it, `previous`.

    Each span of a hot clause starts with the last `runs` results of the spans
    before it, so the frame never reaches outside the span.
    """
    rows = history.where(F.col("measured").isNotNull())
    by, key = ["clause_id"], ["clause_id", SPAN]
    hot = hot_keys(rows, by, "started_at", hot_rows)
    both = with_spans(rows, by, "started_at", hot, "left").withColumn("_seed", F.lit(False))
    if hot.cuts is not None:
        sample = F.struct(*ORDER, "measured")
        cut = with_spans(
            rows.select("clause_id", *ORDER, "measured"), by, "started_at", hot, "inner"
        )
        tails = newest_per_key(cut, key, ORDER, runs).groupBy(*key)
        tails = tails.agg(F.array_sort(F.collect_list(sample)).alias("tail"))  # `runs` at most
        earlier = Window.partitionBy("clause_id").orderBy(SPAN).rowsBetween(-runs, -1)
        seen = tails.withColumn("seen", F.flatten(F.collect_list("tail").over(earlier)))
        first = F.greatest(F.size("seen") - runs + 1, F.lit(1))
        kept = F.slice("seen", first, F.lit(runs))
        seeds = seen.select(*key, F.inline(kept)).withColumn("_seed", F.lit(True))
        both = both.unionByName(seeds, allowMissingColumns=True)
    frame = Window.partitionBy(*key).orderBy(*ORDER).rowsBetween(-runs, -1)
    n = F.count(F.lit(1)).over(frame)
    mean = F.when(n == runs, F.sum(F.col("measured") / runs).over(frame))
    found = both.withColumns({"previous": mean, "samples": n}).where(~F.col("_seed"))
    return found.withColumns(
        {name: _first_of_time(F.col(name)) for name in ("previous", "samples")}
    ).select(*history.columns, "previous", "samples")


def same_weekday_backfill(history: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every result with its baseline of the same weekday, `previous`.

    The results of a clause on one weekday are in order in one place, so the first of a
    day finds its baseline right before it, and the others of the day share it.
    """
    day = day_number(F.col("started_at"), history.schema["started_at"].dataType)
    rows = history.withColumn("_weekday", F.pmod(day, F.lit(7)))
    by = ["clause_id", "_weekday"]
    hot = hot_keys(rows, by, "started_at", hot_rows)
    if hot.cuts is None:
        # Dealt without the samples, which hold the same columns again.
        rows = rows.repartition(*by)
    sample = F.struct(F.col("measured").alias("value"), *ORDER)
    before = running(
        rows, by, ORDER, newest={"_last": F.when(F.col("measured").isNotNull(), sample)}, hot=hot
    ).drop(SPAN)
    of_day = day_number(F.col("_last.started_at"), history.schema["started_at"].dataType) == day
    earlier = F.when(~of_day, F.col("_last"))
    found = running(before, by, ORDER, newest={"_before": earlier}, inclusive=True, hot=hot)
    return found.select(
        *history.columns,
        F.col("_before.value").alias("previous"),
        F.col("_before.started_at").alias("previous_at"),
        F.col("_before.run_id").alias("previous_run"),
    )


def change_absolute(current: Column, previous: Column) -> Column:
    return current - previous


def change_relative(current: Column, previous: Column) -> Column:
    """Percent of the size of the old value; 0 to 0 is 0, from 0 there is none."""
    from_zero = F.when(current == 0, F.lit(0.0))
    over = (current - previous) / F.nullif(F.abs(previous), F.lit(0.0)) * 100
    return F.when(previous == 0, from_zero).otherwise(over)


# What is known of a baseline besides its value: of its newest run, how many runs it is
# of, and how far back they go.
PREVIOUS = ("previous", "previous_at", "previous_run", "samples", "oldest")


NO_BASELINES = (
    "clause_id string, previous double, previous_at timestamp, previous_run string, "
    "samples bigint, oldest timestamp"
)


def story(rows: DataFrame) -> Column:
    """From what to what a value went, and since when; NULL without both."""
    kind = rows.schema["previous_at"].dataType

    def minute(name: str) -> Column:
        time = F.col(name)
        if kind.typeName() == "timestamp":
            time = F.to_utc_timestamp(time, F.current_timezone())
        return F.date_format(time, "yyyy-MM-dd HH:mm")

    unit = F.col("metric_unit")
    then, now = format_value(unit, F.col("previous")), format_value(unit, F.col("value"), noun())
    runs = F.col("samples")
    # The words of messages.
    mean = F.format_string(
        "average %s of the last %d runs (%s to %s UTC) → %s",
        then, runs, minute("oldest"), minute("previous_at"), now,
    )
    weekday = F.when(F.col("change") == "same weekday", " (same weekday)").otherwise("")
    one = F.concat(then, F.lit(" → "), now, F.lit(" since the run of "), minute("previous_at"), F.lit(" UTC"), weekday)
    both = F.col("value").isNotNull() & F.col("previous").isNotNull() & F.col("previous_at").isNotNull()
    return F.when(both, F.when(runs > 1, mean).otherwise(one))


def judge_changes(
    measured: DataFrame, baselines: DataFrame, rules: DataFrame, problem: str | None = None
) -> DataFrame:
    """Clause results of `change` clauses.

    A history that could not be read (`problem`) is an error; no current value
    is judged as any missing value; without a baseline the clause is skipped,
    keeping what it measured.
    """
    known = [c for c in PREVIOUS if c in baselines.columns]
    rows = rules.join(measured, "clause_id", "left")
    return judged_changes(rows.join(baselines.select("clause_id", *known), "clause_id", "left"), problem)


def judged_changes(rows: DataFrame, problem: str | None = None) -> DataFrame:
    """The same of rows that hold rule, measured `value` and `previous` side by side.

    Where they also hold `previous_at` (and `samples`, `oldest`), the detail tells from what to
    what the value went, and since when.
    """
    joined = rows
    now, previous = F.col("value"), F.col("previous")
    change = F.when(F.col("relative"), change_relative(now, previous)).otherwise(
        change_absolute(now, previous)
    )
    if "previous_at" in rows.columns:
        joined = rows.withColumn("detail", F.coalesce(story(rows), F.col("detail")))
    told = joined.withColumns(
        {
            "measured": now,
            "value": change,
            "error": F.coalesce(F.lit(problem).cast("string"), F.col("error")),
            "skipped": F.when(now.isNull(), F.lit(None).cast("string"))
            .when(previous.isNull(), "no earlier result to compare with")
            .when(change.isNull(), "previous value was 0: a percent change has no meaning"),
        }
    )
    skips = F.col("skipped").isNotNull() & F.col("error").isNull()
    outcome = F.when(skips, "skipped").otherwise(outcome_of(F.col("value"), F.col("error")))
    judged = told.withColumn("outcome", outcome)
    said = message_of(F.col("value"), F.col("outcome"), F.col("detail"), F.col("error"))
    return judged.withColumn("message", F.when(skips, F.col("skipped")).otherwise(said)).drop(
        "skipped"
    )
