"""A check's history as a series: rule changes, plotted segments, summaries.

All take history rows `check_id, started_at, run_id, outcome, value, metric,
expression, dataset, definition_version`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import outcome_counts
from assay.functions.predicates import finite
from assay.operators.ordered import running
from assay.sources.results import settled

ORDER = ("started_at", "run_id")


def with_older(history: DataFrame, **hot: int) -> DataFrame:
    """Each result with the rule and definition version of the one before it."""
    # The version in a struct, so that an unknown one is not passed over.
    before = F.struct(
        "expression", "dataset", F.col("definition_version").alias("version")
    )
    return running(history, ["check_id"], ORDER, newest={"older": before}, **hot)


def rule_changed() -> dict[str, Column]:
    """Whether the expression and the dataset differ from the result before."""
    first = F.col("older").isNull()
    return {
        f"{name}_changed": ~first & ~F.col(name).eqNullSafe(F.col(f"older.{name}"))
        for name in ("expression", "dataset")
    }


def definition_changed() -> Column:
    """Whether the definition version differs from the one before, both known."""
    return F.coalesce(F.col("older.version") != F.col("definition_version"), F.lit(False))


def rule_changes(history: DataFrame, **hot: int) -> DataFrame:
    """Results judged by another expression or dataset than the one before."""
    return (
        with_older(history, **hot)
        .withColumns(rule_changed())
        .where(F.col("expression_changed") | F.col("dataset_changed"))
        .withColumn("older_expression", F.col("older.expression"))
        .drop("older")
    )


def definition_changes(history: DataFrame, **hot: int) -> DataFrame:
    """Results under another definition version than the one before, both known."""
    found = with_older(history, **hot).where(definition_changed())
    return found.withColumn("older_version", F.col("older.version")).drop("older")


def plotted(axis_metric: Column) -> Column:
    """Whether a result is a point on the axis: judged, finite, of its metric."""
    value = finite(F.col("value"))
    on_axis = value.isNotNull() & F.col("metric").eqNullSafe(axis_metric)
    return on_axis & (F.col("outcome") != "error")


def value_segments(history: DataFrame, axis_metric: Column, **hot: int) -> DataFrame:
    """Runs of consecutive plotted values: one row each, oldest first by `breaks`.

    Two plotted results are in one segment when no other result lies between
    them, that is when as many unplotted ones came before both.
    """
    marked = history.withColumn("_on", plotted(axis_metric))
    off = F.when(F.col("_on"), 0).otherwise(1)
    counted = running(marked, ["check_id"], ORDER, totals={"breaks": off}, **hot)
    return (
        counted.where(F.col("_on"))
        .groupBy("check_id", "breaks")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("started_at").alias("first_at"),
            F.max("started_at").alias("last_at"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
    )


def current_rule_run(history: DataFrame, current: DataFrame) -> DataFrame:
    """The newest unbroken results judged by each check's current expression.

    `current` holds `check_id, expression`. The newest result judged by
    another expression bounds the run, so no window is needed.
    """
    rule = current.select("check_id", F.col("expression").alias("current_expression"))
    rows = history.join(rule, "check_id")
    at = F.struct(*ORDER)
    other = ~F.col("expression").eqNullSafe(F.col("current_expression"))
    edges = rows.groupBy("check_id").agg(F.max(F.when(other, at)).alias("edge"))
    return (
        rows.join(settled(edges), "check_id")
        .where(F.col("edge").isNull() | (at > F.col("edge")))
        .select(*history.columns)
    )


def history_summary(history: DataFrame, axis_metric: Column, **hot: int) -> DataFrame:
    """Per check: outcome counts, span, newest plotted value, and rule changes."""
    on, at = plotted(axis_metric), F.struct(*ORDER)
    off_axis = finite(F.col("value")).isNotNull() & (F.col("outcome") != "error") & ~on
    changed = rule_changed()
    return with_older(history, **hot).groupBy("check_id").agg(
        *outcome_counts(F.col("outcome")),
        F.min("started_at").alias("first_at"),
        F.max("started_at").alias("last_at"),
        F.max_by("value", F.when(on, at)).alias("latest_value"),
        F.max_by("outcome", F.when(on, at)).alias("latest_outcome"),
        F.count_if(off_axis).alias("off_axis"),
        F.count_if(changed["expression_changed"] | changed["dataset_changed"]).alias(
            "rule_changes"
        ),
        F.count_if(definition_changed()).alias("definition_changes"),
    )
