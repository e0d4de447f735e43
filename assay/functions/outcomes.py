"""Outcomes and lifecycle states as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes with their severity, and the groups built from them.
SEVERITY = {"pass": 0, "skipped": 0, "warn": 1, "fail": 2, "error": 3}
EVALUATED = ("pass", "warn", "fail")
ALERTING = ("fail", "pass")
# Problems first, with `none` for a check that never ran.
PROBLEM_ORDER = ("fail", "error", "warn", "none", "skipped", "pass")
# Lifecycle states of a check.
STATES = ("active", "disabled", "retired")


def known_outcome(outcome: Column) -> Column:
    """The outcome, with any word this library does not know read as `error`."""
    return F.when(outcome.isin(*SEVERITY), outcome).otherwise(F.lit("error"))


def known_state(state: Column) -> Column:
    """The lifecycle state, with any unknown word read as `retired`."""
    return F.when(state.isin("active", "disabled"), state).otherwise(F.lit("retired"))


def severity(outcome: Column) -> Column:
    """How bad an outcome is, 0 to 3."""
    worse = F.when(outcome == "warn", 1).when(outcome == "fail", 2)
    return worse.when(outcome == "error", 3).otherwise(0)


def worst_outcome(outcome: Column) -> Column:
    """Aggregate: the worst outcome, `skipped` only when there is nothing else."""
    judged = F.max(F.when(outcome != "skipped", severity(outcome)))
    return (
        F.when(judged.isNull(), "skipped")
        .when(judged == 3, "error")
        .when(judged == 2, "fail")
        .when(judged == 1, "warn")
        .otherwise("pass")
    )


def is_evaluated(outcome: Column) -> Column:
    return outcome.isin(*EVALUATED)


def position_in(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; values not in it come last."""
    return F.coalesce(
        *[F.when(value == word, F.lit(i)) for i, word in enumerate(order)],
        F.lit(len(order)),
    )


def outcome_counts(outcome: Column) -> list[Column]:
    """Aggregates: one count per outcome, and all rows as `total`."""
    counts = [
        F.count_if(outcome == word).alias(word)
        for word in ("pass", "warn", "fail", "error", "skipped")
    ]
    return [*counts, F.count(F.lit(1)).alias("total")]


def outcome_tally(counts: dict[str, Column]) -> Column:
    """`3 pass, 1 warn` from counts per outcome; zero counts are left out."""
    return F.concat_ws(
        ", ",
        *[
            F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(word)))
            for word, n in counts.items()
        ],
    )
