"""Dashboard roll-ups over checks with their newest result.

Checks come as `check_id, name, dataset, datasource, state, owner, tags, path,
expression`; with their head they also have `outcome` (NULL when never run),
`started_at`, `run_id`, `last_outcome`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.functions.outcomes import PROBLEM_ORDER, known_outcome, outcome_counts, position_in
from assay.operators.judge import run_outcome


def with_latest(checks: DataFrame, heads: DataFrame) -> DataFrame:
    """Every check with its head, or NULLs when it never ran."""
    return checks.join(heads, "check_id", "left")


def status(outcome: Column | None = None) -> Column:
    """A check's status: its newest outcome, or `none`."""
    outcome = F.col("outcome") if outcome is None else outcome
    return F.coalesce(outcome, F.lit("none"))


def enabled() -> Column:
    return F.col("state") == "active"


def status_columns() -> list[Column]:
    """Aggregates: how many checks have each status, and how many there are."""
    counts = [F.count_if(status() == word).alias(word) for word in PROBLEM_ORDER]
    return [*counts, F.count(F.lit(1)).alias("total")]


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.agg(*status_columns())


def active_problem_count(checks: DataFrame) -> DataFrame:
    problems = checks.where(enabled() & F.col("outcome").isin("fail", "error"))
    return problems.agg(F.count(F.lit(1)).alias("problems"))


def errors_last_failing(checks: DataFrame) -> DataFrame:
    """Checks in error whose data last failed."""
    hidden = checks.where((F.col("outcome") == "error") & (F.col("last_outcome") == "fail"))
    return hidden.agg(F.count(F.lit(1)).alias("checks"))


def problems_first(checks: DataFrame, *then: str) -> DataFrame:
    """Checks in order of urgency, then by the given columns."""
    return checks.orderBy(position_in(status(), PROBLEM_ORDER), *then)


def by_name(values: Column) -> Column:
    """An array of names without NULLs and repeats, case aside, then as written."""
    keyed = F.transform(
        F.array_compact(values), lambda v: F.struct(F.lower(v).alias("k"), v.alias("v"))
    )
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: s["v"])


def dataset_rollup(checks: DataFrame) -> DataFrame:
    """Per dataset: worst status of its enabled checks, counts, newest scan,
    owners and tags.

    Tags are exploded and made distinct on the way into the shuffle, so a
    dataset is never gathered check by check.
    """
    by = ("datasource", "dataset")
    worst = F.min(F.when(enabled(), position_in(status(), PROBLEM_ORDER)))
    words = F.array(*[F.lit(word) for word in PROBLEM_ORDER])
    rolled = checks.groupBy(*by).agg(
        *status_columns(),
        worst.alias("worst"),
        F.max("started_at").alias("last_scanned"),
        by_name(F.collect_set("owner")).alias("owners"),
    )
    tags = (
        checks.select(*by, F.explode("tags").alias("tag"))
        .groupBy(*by)
        .agg(by_name(F.collect_set("tag")).alias("tags"))
    )
    named = F.coalesce(F.get(words, F.col("worst")), F.lit("disabled")).alias("status")
    return rolled.join(tags, list(by), "left").select(
        *by,
        named,
        *PROBLEM_ORDER,
        "total",
        "last_scanned",
        "owners",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def stale_datasets(checks: DataFrame, runs: DataFrame, hours: int = 24) -> DataFrame:
    """Datasets whose enabled checks were last scanned long before the newest run.

    Those never scanned (`last_scanned` NULL) come first, then the longest ago;
    without any run there are none."""
    newest = runs.agg(F.max("started_at").alias("newest")).scalar()
    scanned = (
        checks.where(enabled())
        .groupBy("datasource", "dataset")
        .agg(F.max("started_at").alias("last_scanned"))
    )
    late = F.col("last_scanned") < newest - F.make_dt_interval(hours=F.lit(hours))
    never = F.col("last_scanned").isNull() & newest.isNotNull()
    order = [F.col("last_scanned").asc_nulls_first(), "datasource", "dataset"]
    return scanned.where(late | never).orderBy(*order)


def common_folder(checks: DataFrame, *by: str) -> DataFrame:
    """The longest folder every check's file lies in, as `folder`, per group.

    The smallest and the largest path share what all paths share.
    """
    folders = text.folder_parts(F.col("path"))
    ends = checks.groupBy(*by).agg(F.min(folders).alias("a"), F.max(folders).alias("b"))
    shared = text.shared_prefix(F.col("a"), F.col("b"))
    return ends.select(*by, F.array_join(shared, "/").alias("folder"))


def folder_rollup(checks: DataFrame) -> DataFrame:
    """Status counts of every folder (ending in `/`) and file of the check tree."""
    parts = F.split("path", "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    node = F.transform(
        steps,
        lambda n: F.concat(
            F.array_join(F.slice(parts, F.lit(1), n), "/"),
            F.when(n < F.size(parts), "/").otherwise(""),
        ),
    )
    return (
        checks.withColumn("node", F.explode(node)).groupBy("node").agg(*status_columns())
    )


def run_counts_served(runs: DataFrame) -> DataFrame:
    """A stored run's counts, with the skipped ones the rest of its total."""
    counted = F.col("passed") + F.col("warned") + F.col("failed") + F.col("errored")
    return runs.select(
        "run_id",
        "total",
        F.col("passed").alias("pass"),
        F.col("warned").alias("warn"),
        F.col("failed").alias("fail"),
        F.col("errored").alias("error"),
        (F.col("total") - counted).alias("skipped"),
    )


def keyed_run_tally(results: DataFrame) -> DataFrame:
    """Per run and dataset: how many checks had each outcome, over all attempts."""
    known = results.withColumn("outcome", known_outcome(F.col("outcome")))
    return known.groupBy("run_id", "datasource", "dataset").agg(
        *outcome_counts(F.col("outcome")),
        run_outcome(F.col("outcome"), F.col("position")).alias("outcome"),
    )


def run_tally(results: DataFrame) -> DataFrame:
    """Per run: how many checks had each outcome, over all datasets and attempts."""
    known = results.withColumn("outcome", known_outcome(F.col("outcome")))
    return known.groupBy("run_id").agg(
        *outcome_counts(F.col("outcome")),
        run_outcome(F.col("outcome"), F.col("position")).alias("outcome"),
    )


def trend(runs: DataFrame, limit: int = 30) -> DataFrame:
    """Problems per run over the newest runs, oldest first; none for a single run."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    problems = (F.col("failed") + F.col("errored")).alias("problems")
    enough = newest.agg((F.count(F.lit(1)) >= 2).alias("enough")).scalar()
    bars = newest.select("run_id", "started_at", problems, "outcome").where(enough)
    return bars.orderBy("started_at", "run_id")


def not_loaded_from_run(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Per run: checks it counted that are not loaded now with it as their newest."""
    latest = checks.groupBy("run_id").agg(F.count(F.lit(1)).alias("loaded"))
    left = F.col("total") - F.coalesce("loaded", F.lit(0))
    return runs.join(latest, "run_id", "left").select(
        "run_id", F.greatest(left, F.lit(0)).alias("not_loaded")
    )


def datasource_counts(checks: DataFrame) -> DataFrame:
    """Per datasource: loaded datasets and checks, and checks by lifecycle state.

    Datasets are counted in two steps, so a datasource holding most checks is
    first folded to its datasets.
    """
    loaded = F.col("state") != "retired"
    per_dataset = checks.groupBy("datasource", "dataset").agg(
        F.count_if(loaded).alias("checks"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("active", "disabled", "retired")],
    )
    names = ("checks", "active", "disabled", "retired")
    return per_dataset.groupBy("datasource").agg(
        F.count_if(F.col("checks") > 0).alias("datasets"), *[F.sum(n).alias(n) for n in names]
    )
