"""State-change alerts: which to write, which are still news, how they are sent.

`changes` are state changes (`check_id, run_id, started_at, result_id, event,
previous_outcome`); `deliveries` are outbox rows (`delivery_id, run_id,
check_id, notifier, event, previous_outcome, created_at, attempts, sent_at,
abandoned_at`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.history import recorded_after
from assay.operators.ordered import running
from assay.sources.results import settled

# An alert is given up on after so many sends, or this long.
MOST_ATTEMPTS = 5
MOST_HOURS = 24


def changes_in_run(changes: DataFrame, run_id: str) -> DataFrame:
    return changes.where(F.col("run_id") == run_id)


def alerts_to_write(
    changes: DataFrame,
    checks: DataFrame,
    deliveries: DataFrame,
    history: DataFrame | None = None,
) -> DataFrame:
    """One row per change and notifier of its check, without those already written.

    A resumed run may come late: give it the `history`, and changes of checks that
    have a newer result by now are no news.
    """
    news = changes
    if history is not None:
        superseded = recorded_after(history, changes.select("check_id", "started_at", "run_id"))
        news = changes.join(superseded, ["check_id", "run_id"], "left_anti")
    told = news.join(checks.select("check_id", "notify"), "check_id").select(
        "run_id", "check_id", "event", "previous_outcome", F.explode("notify").alias("notifier")
    )
    key = ["run_id", "check_id", "notifier", "event"]
    return told.join(deliveries.select(*key), key, "left_anti")


def delivery_status() -> Column:
    sent, abandoned = F.col("sent_at"), F.col("abandoned_at")
    return F.when(sent.isNotNull(), "sent").when(abandoned.isNotNull(), "abandoned").otherwise(
        "pending"
    )


def join_alerts(
    changes: DataFrame, checks: DataFrame, runs: DataFrame, deliveries: DataFrame
) -> DataFrame:
    """State changes with their check and run key, and their deliveries by
    notifier: NULL when the run had no key, so nothing was recorded.

    A change has at most one delivery per notifier its check names.
    """
    status = F.struct("notifier", delivery_status().alias("status"), "attempts")
    key = ["run_id", "check_id", "event"]
    told = deliveries.groupBy(*key).agg(F.array_sort(F.collect_list(status)).alias("told"))
    joined = (
        changes.join(checks, "check_id")
        .join(runs.select("run_id", "run_key"), "run_id")
        .join(told, key, "left")
    )
    none = F.array().cast(told.schema["told"].dataType)
    told_or_none = F.when(F.col("run_key").isNotNull(), F.coalesce("told", none))
    return joined.withColumn("deliveries", told_or_none).drop("told")


def join_outbox(
    deliveries: DataFrame,
    runs: DataFrame,
    checks: DataFrame,
    results: DataFrame,
    dataset_runs: DataFrame,
) -> DataFrame:
    """Outbox rows with their run and check, and the result and recording time
    where those still exist."""
    of_result = results.select(
        "run_id", "check_id", "result_id", "datasource", "dataset", F.col("outcome").alias("result_outcome")
    )
    of_dataset = dataset_runs.select(
        "run_id", "datasource", "dataset", F.col("finished_at").alias("recorded_at")
    )
    return (
        deliveries.join(runs.select("run_id", "started_at", "run_key"), "run_id")
        .join(checks.select("check_id", "name"), "check_id")
        .join(of_result, ["run_id", "check_id"], "left")
        .join(of_dataset, ["run_id", "datasource", "dataset"], "left")
    )


def alerts_pending(deliveries: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """What is left to send for runs with a key, with two reasons not to.

    `superseded`: the thread (key, check, notifier) has a later alert, or it is a
    recovery from a failure nobody was told of. `expired`: attempts or age are
    past their limit.
    """
    keyed = deliveries.join(
        runs.where(F.col("run_key").isNotNull()).select(
            "run_id", "project", "run_key", "started_at"
        ),
        "run_id",
    )
    keyed = settled(keyed)  # read three times
    thread = ["project", "run_key", "check_id", "notifier"]
    at = F.struct("started_at", "run_id")
    told = F.struct("event", F.col("sent_at").isNotNull().alias("sent"))
    # Of several alerts of one run, the last by event is what the next follows.
    per_run = keyed.groupBy(*thread, "started_at", "run_id").agg(F.max(told).alias("told"))
    before = running(
        per_run, thread, ("started_at", "run_id"), newest={"before": F.col("told")}
    ).drop("told")
    last = keyed.groupBy(*thread).agg(F.max(at).alias("last"))
    waiting = keyed.where(F.col("sent_at").isNull() & F.col("abandoned_at").isNull())
    joined = waiting.join(last, thread).join(before, [*thread, "started_at", "run_id"])
    untold = (F.col("before.event") == "failing") & ~F.col("before.sent")
    dropped = (F.col("event") == "recovered") & F.coalesce(untold, F.lit(False))
    too_old = now - F.make_dt_interval(hours=F.lit(MOST_HOURS))
    return joined.withColumns(
        {
            "superseded": (F.col("last") > at) | dropped,
            "expired": (F.col("attempts") >= MOST_ATTEMPTS) | (F.col("created_at") < too_old),
        }
    ).drop("last", "before")


def notification_batches(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """The events of every message: one message per run and notifier.

    Rows stay rows, in the run's recorded order by `result_id`, with the size
    of their message; a run that changed most checks is never one array.
    """
    placed = alerts.join(results.select("run_id", "check_id", "result_id"), ["run_id", "check_id"])
    sizes = placed.groupBy("run_id", "notifier").agg(F.count(F.lit(1)).alias("events"))
    return placed.join(sizes, ["run_id", "notifier"]).select(
        "run_id", "notifier", "events", "result_id", "check_id", "event", "previous_outcome"
    )
