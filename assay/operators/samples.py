"""Baselines from a table of each clause's newest samples, without reading a history.

`samples` has a row per clause and metric. Its `ring` holds the newest measured values;
its `days` hold, for each UTC weekday, the two newest days that have any, and of each
day the newest sample and the newest one of another logical run, so that leaving out
the attempts at one run key still finds the right one. A batch of results moves both
on, late results included: what is kept depends on places in history alone.

Where the rows kept cannot tell (a run further back than they reach, or more
attempts at one key than the ring has room for) the clause is read from the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.rows import literal_rows
from assay.functions.times import day_number
from assay.operators.change import (
    ORDER,
    PREVIOUS,
    baseline_last_runs,
    baseline_previous,
    baseline_same_weekday,
    earlier_samples,
)
from assay.operators.ordered import newest_per_key
from assay.spec import Suite

KEY = ("clause_id", "metric")
# Samples kept of a clause. A baseline of the last runs takes 100 at most.
RING = 100
# Days kept of each weekday: the day of the newest run, and the one before it.
DAYS = 2
SAMPLE = ("started_at", "run_id", "run_key", "measured")


def newest_samples(history: DataFrame) -> DataFrame:
    """The table of samples of a whole history.

    Tasks keep the newest rows of each clause before the shuffle; no sort of a clause's
    history is needed.
    """
    rows = history.where(F.col("measured").isNotNull()).select(*KEY, *SAMPLE)
    return _gathered(rows, _by_day(rows))


def _by_day(rows: DataFrame) -> DataFrame:
    """The newest sample of each clause, day and logical run; two of a day at most."""
    dtype = rows.schema["started_at"].dataType
    dated = rows.withColumn("day", day_number(F.col("started_at"), dtype))
    # A run without a key is a logical run of its own.
    run = F.coalesce(F.concat(F.lit("k"), "run_key"), F.concat(F.lit("r"), "run_id"))
    newest = F.max(F.struct(*SAMPLE)).alias("_s")
    runs = dated.groupBy(*KEY, "day", run.alias("_run")).agg(newest).select(*KEY, "day", "_s.*")
    return newest_per_key(runs, [*KEY, "day"], ORDER, 2).drop("rank")


def _gathered(ring: DataFrame, daily: DataFrame) -> DataFrame:
    sample = F.struct(*SAMPLE)
    newest = newest_per_key(ring, KEY, ORDER, RING).groupBy(*KEY)
    rings = newest.agg(F.reverse(F.array_sort(F.collect_list(sample))).alias("ring"))
    of_day = daily.groupBy(*KEY, "day").agg(
        F.reverse(F.array_sort(F.collect_list(sample))).alias("samples")  # two at most
    )
    of_day = of_day.withColumn("weekday", F.pmod("day", F.lit(7)))
    last = newest_per_key(of_day, [*KEY, "weekday"], ["day"], DAYS).groupBy(*KEY)
    days = last.agg(F.array_sort(F.collect_list(F.struct("weekday", "day", "samples"))).alias("days"))
    return rings.join(days, list(KEY))


def advance_samples(
    samples: DataFrame, batch: DataFrame, rebuilt: DataFrame | None = None, history: DataFrame | None = None
) -> DataFrame:
    """The table after a batch of results; equal to that of the whole history.

    Only clauses of the batch are taken apart. `rebuilt` holds the `clause_id` of clauses
    of which the history lost results: those are taken from the `history` anew.
    """
    rows = batch.where(F.col("measured").isNotNull()).select(*KEY, *SAMPLE)
    if rebuilt is not None:
        again = rebuilt.select("clause_id").distinct()
        samples = samples.join(again, "clause_id", "left_anti")
        rows = rows.join(again, "clause_id", "left_anti")
    touched = rows.select(*KEY).distinct()
    same = samples.join(touched, list(KEY), "left_anti")
    held = samples.join(touched, list(KEY), "left_semi")
    ring = held.select(*KEY, F.inline("ring")).unionByName(rows)
    kept = held.select(*KEY, F.explode("days").alias("d")).select(*KEY, F.inline("d.samples"))
    moved = same.unionByName(_gathered(ring, _by_day(kept.unionByName(rows))))
    if rebuilt is None:
        return moved
    return moved.unionByName(newest_samples(history.join(again, "clause_id", "left_semi")))


WANTED = "clause_id string, metric string, baseline string, runs int"
FOUND = ("clause_id", *PREVIOUS)


def wanted_of(spark, suites: Sequence[Suite]) -> DataFrame:
    """What the `change` clauses of suites compare with."""
    rows = [
        (clause_id, clause.metric, clause.change.baseline, clause.change.runs)
        for suite in suites
        for clause_id, _, clause in suite.clause_ids()
        if clause.change is not None
    ]
    return literal_rows(spark, WANTED, rows)


def stored_baselines(
    samples: DataFrame,
    wanted: DataFrame,
    now: Column,
    run_key: str | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """What a run at `now` compares its clauses with: `FOUND`, a row per wanted clause that has one.

    `previous_at` and `previous_run` are those of the newest sample taken; of the
    mean of the last runs `samples` says how many there were, and `oldest` how far back they
    go. Without a `history`, clauses that the samples cannot tell are an error.
    """
    dtype = samples.schema["ring"].dataType.elementType["started_at"].dataType
    known = wanted.join(samples, list(KEY))

    def counts(sample: Column) -> Column:
        key = sample["run_key"]
        other = F.lit(True) if run_key is None else key.isNull() | (key != run_key)
        return (sample["started_at"] < now) & other

    today = day_number(now.cast(dtype), dtype)
    runs = F.col("runs")
    usable = F.filter("ring", counts)
    whole = F.size("ring") < RING  # then the ring has all there ever was
    weekday = F.filter("days", lambda d: (d["weekday"] == F.pmod(today, F.lit(7))))
    old = F.filter(weekday, lambda d: d["day"] <= today - 7)
    of_days = F.flatten(F.transform(old, lambda d: F.filter(d["samples"], counts)))
    on_day = F.array_max(of_days)
    told = known.select(
        "clause_id",
        "baseline",
        "metric",
        "runs",
        F.when(F.col("baseline") == "same weekday", on_day).otherwise(F.get(usable, 0)).alias("_one"),
        F.when(F.col("baseline") == "last runs", F.slice(usable, F.lit(1), runs)).alias("_many"),
        F.when(F.col("baseline") == "same weekday", on_day.isNotNull() | (F.size(weekday) < DAYS))
        .when(F.col("baseline") == "last runs", whole | (F.size(usable) >= runs))
        .otherwise(whole | (F.size(usable) > 0))
        .alias("_told"),
    )
    many = F.col("_many")
    mean = F.when(
        F.size(many) == runs,
        F.aggregate(many, F.lit(0.0), lambda sum_, s: sum_ + s["measured"] / runs),
    )
    of_many = many.isNotNull()
    value = F.when(of_many, mean).otherwise(F.col("_one.measured"))
    if history is None:
        lost = F.raise_error(F.concat(F.lit("older samples are needed of clause "), F.col("clause_id").cast("string")))
        value = F.when(F.col("_told"), value).otherwise(lost)
    found = told.where(F.lit(True) if history is None else F.col("_told")).select(
        "clause_id",
        value.alias("previous"),
        F.when(~of_many | mean.isNotNull(), F.col("_one.started_at")).alias("previous_at"),
        F.when(~of_many | mean.isNotNull(), F.col("_one.run_id")).alias("previous_run"),
        F.when(of_many, F.size(many)).otherwise(1).cast("long").alias("samples"),
        F.when(of_many, F.array_min(F.transform(many, lambda s: s["started_at"])))
        .otherwise(F.col("_one.started_at"))
        .alias("oldest"),
    )
    if history is not None:
        found = found.unionByName(_from_history(told.where(~F.col("_told")), history, now, run_key))
    return found.where(F.col("previous").isNotNull())


def _from_history(asked: DataFrame, history: DataFrame, now: Column, run_key: str | None) -> DataFrame:
    """The same for clauses asked of the history; an empty `asked` reads none of its rows."""
    asked = asked.select(*KEY, "baseline", "runs")
    rows = earlier_samples(history, now, run_key)
    one = F.lit(1).cast("long").alias("samples")

    def of(kind: str) -> DataFrame:
        return rows.join(asked.where(F.col("baseline") == kind), list(KEY), "left_semi")

    def single(df: DataFrame) -> DataFrame:
        return df.select(
            "clause_id",
            "previous",
            F.col("started_at").alias("previous_at"),
            F.col("run_id").alias("previous_run"),
            one,
            F.col("started_at").alias("oldest"),
        )

    found = single(baseline_previous(of("previous run"))).unionByName(
        single(baseline_same_weekday(of("same weekday"), now))
    )
    # Clauses ask for different numbers of runs; each number is one pass over its clauses.
    last = asked.where(F.col("baseline") == "last runs")
    for row in last.select("runs").distinct().collect():
        of_runs = rows.join(last.where(F.col("runs") == row["runs"]), list(KEY), "left_semi")
        at, run_id = F.col("started_at").alias("previous_at"), F.col("run_id").alias("previous_run")
        means = baseline_last_runs(of_runs, row["runs"])
        found = found.unionByName(means.select("clause_id", "previous", at, run_id, "samples", "oldest"))
    return found
