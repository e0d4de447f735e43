"""Reading the result tables: joins, pages, and which results count.

No join is hinted: Spark broadcasts a side only when it measures it small, and
splits a hot key of a shuffled join at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.ordered import newest_row
from assay.sources.results import settled

RUN_ORDER = ("started_at", "run_id")
# After 2**14 days, 45 years, a page reads all that is left.
MOST_PROBES = 15
# The events an alert can be about.
EVENTS = ("failing", "erroring", "recovered")


def finished(runs: DataFrame, project: str | None = None) -> DataFrame:
    """A project's runs that have ended: a run in progress has no exit code."""
    done = runs.where(F.col("exit_code").isNotNull())
    return done if project is None else done.where(F.col("project") == project)


def read_history(results: DataFrame, runs: DataFrame, project: str | None = None) -> DataFrame:
    """Results of finished runs, of one project or all, with when and how each run was.

    Stored results carry their project and day: those join too, so that only
    the project's partitions, and of those the days of its runs, are read.
    """
    of_run = finished(runs, project)
    kept = ["run_id", "project", "started_at", "run_key", "day"]
    of_run = of_run.select(*[c for c in kept if c in runs.columns])
    if project is not None and "project" in results.columns:
        results = results.where(F.col("project") == project)
    both = [c for c in ("run_id", "project", "day") if c in results.columns and c in of_run.columns]
    told = [c for c in ("started_at", "run_key") if c in of_run.columns]
    return results.drop(*told).join(of_run, both)


def join_history(results: DataFrame, runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Every result with its run and its check."""
    return results.join(runs, "run_id").join(checks, "check_id")


def join_heads(
    heads: DataFrame, checks: DataFrame, results: DataFrame, runs: DataFrame
) -> DataFrame:
    """Each check's head with the check, its newest result and that run.

    `results` bring the columns heads do not have; `runs` theirs. Heads are a
    row per check: read from a table they are small, and the results stay where
    they are.
    """
    of_result = results.drop("check_id", "run_id", "started_at", "outcome")
    of_run = runs.drop("started_at", "outcome")
    return of_result.join(heads, "result_id").join(checks, "check_id").join(of_run, "run_id")


def latest_results(history: DataFrame) -> DataFrame:
    """Each check's newest result, by run start and then run id."""
    return newest_row(history, ["check_id"], RUN_ORDER)


def join_retired(registry: DataFrame, loaded: DataFrame, heads: DataFrame) -> DataFrame:
    """Retired checks that are not loaded again, with their last state if any."""
    gone = registry.where(F.col("state") == "retired").join(
        loaded.select("check_id"), "check_id", "left_anti"
    )
    return gone.join(heads, "check_id", "left")


def definition_latest(definitions: DataFrame) -> DataFrame:
    """Each check's newest definition version."""
    return newest_row(definitions, ["check_id"], ["version"])


def join_history_definition(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every result with the version it ran under, NULL where none was kept."""
    versions = definitions.select("definition_id", F.col("version").alias("definition_version"))
    return history.join(versions, "definition_id", "left")


def recorded_after(history: DataFrame, places: DataFrame) -> DataFrame:
    """The `places` whose check has a result in a newer run.

    `places` holds `check_id, started_at, run_id`. A history is first folded
    to each check's newest place, so no pair of rows is formed; those are a
    row per check, so they are settled and the places stay where they are.
    """
    at = F.struct(*RUN_ORDER)
    newest = history.groupBy("check_id").agg(F.max(at).alias("newest"))
    both = places.join(settled(newest), "check_id")
    return both.where(F.col("newest") > at).select(*places.columns).distinct()


def distinct_checks(results: DataFrame) -> DataFrame:
    return results.select("check_id").distinct()


def older_than(key: Sequence[tuple[str, Column]]) -> Column:
    """Rows after a page's last one, in newest-first order of the key columns."""
    here = F.struct(*[F.col(name) for name, _ in key])
    return here < F.struct(*[value.alias(name) for name, value in key])


def newest_page(
    rows: DataFrame,
    order: Sequence[str],
    limit: int,
    before: Sequence[Column] | None = None,
) -> DataFrame:
    """One newest-first page; `before` holds the order columns of the last row shown."""
    if before is not None:
        rows = rows.where(older_than(list(zip(order, before, strict=True))))
    return rows.orderBy(*[F.col(name).desc() for name in order]).limit(limit)


def stored_page(
    rows: DataFrame,
    order: Sequence[str],
    limit: int,
    newest: date,
    before: Sequence[Column] | None = None,
    day: str = "day",
) -> DataFrame:
    """`newest_page` of a table partitioned by day, reading the newest days until it is full.

    `newest` is the last day that can hold a row of the page: that of the page's keyset, or today.
    Ranges of 1, 2, 4, ... days back from it are read until they hold `limit` rows; a page of a
    busy table reads a day or two of files however long the table is, and no page asks more
    than `MOST_PROBES` times. Days must rise with the order.
    """
    if before is not None:
        rows = rows.where(older_than(list(zip(order, before, strict=True))))
    rows = rows.where(F.col(day) <= F.lit(newest))
    for probe in range(MOST_PROBES):
        first = newest - timedelta(days=(1 << probe) - 1)
        recent = rows.where(F.col(day) >= F.lit(first))
        if len(recent.select(day).limit(limit).collect()) == limit:
            return newest_page(recent, order, limit)
    return newest_page(rows, order, limit)


def runs_page(
    runs: DataFrame, project: str, limit: int, before: Sequence[Column] | None = None
) -> DataFrame:
    return newest_page(finished(runs, project), RUN_ORDER, limit, before)


def history_page(
    history: DataFrame, check_id: object, limit: int, before: Sequence[Column] | None = None
) -> DataFrame:
    rows = history.where(F.col("check_id") == check_id)
    return newest_page(rows, RUN_ORDER, limit, before)


def alerts_page(
    changes: DataFrame,
    limit: int,
    events: Sequence[str] = EVENTS,
    before: Sequence[Column] | None = None,
) -> DataFrame:
    rows = changes.where(F.col("event").isin(*[e for e in events if e in EVENTS]))
    return newest_page(rows, (*RUN_ORDER, "result_id"), limit, before)


def prefix_match(ids: DataFrame, column: str, prefix: str, limit: int = 10) -> DataFrame:
    """Up to `limit` ids that start with a prefix, case kept, in id order."""
    found = ids.where(F.col(column).startswith(prefix)).select(column)
    return found.orderBy(column).limit(limit)
