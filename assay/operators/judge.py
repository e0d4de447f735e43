"""Judging: measured values against rules, folded into checks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.outcomes import known_outcome, outcome_counts, severity, worst_outcome
from assay.functions.rows import literal_rows
from assay.functions.text import format_value
from assay.operators.metrics import metric_named
from assay.spec import Rule, Suite

# The words of messages.
NO_VALUE = "no value to evaluate"
EXPECTED, WARNED, FAILED = "expected ", "warn when ", "fail when "

RULE_PARTS = ("op", "low", "high", "text")
_RULE = "{0}_op string, {0}_low double, {0}_high double, {0}_text string"
RULES = (
    "clause_id string, check_id string, position int, clause_key string, metric string, "
    "expression string, unit string, change string, change_runs int, relative boolean, "
    "metric_unit string, noun_one string, noun_many string, "
    + ", ".join(_RULE.format(name) for name in ("expect", "warn", "fail"))
)


def rules_of(spark: SparkSession, suite: Suite) -> DataFrame:
    """One row per clause of a suite: its place, its metric and its rules."""
    rows = []
    for position, (clause_id, check, clause) in enumerate(suite.clause_ids()):
        metric = metric_named(clause.metric)
        row = [clause_id, suite.check_id(check), position, clause.key, clause.metric]
        unit = "percent" if clause.relative_change else metric.unit
        change = clause.change
        row += [clause.expression, unit, change and change.baseline, change and change.runs]
        row += [clause.relative_change, metric.unit, *(metric.noun or (None, None))]
        for rule in (clause.expect, clause.warn, clause.fail):
            row += list(rule.as_row()) if rule else [None] * len(RULE_PARTS)
        rows.append(row)
    return literal_rows(spark, RULES, rows)


def holds(value: Column, op: Column, low: Column, high: Column) -> Column:
    """Whether a value satisfies a rule given as columns.

    NaN is unordered here: it only ever satisfies `!=` and `not between`.
    """
    inside = (value >= low) & (value <= high)
    ordered = (
        F.when(op == "=", value == low)
        .when(op == "!=", value != low)
        .when(op == "<", value < low)
        .when(op == "<=", value <= low)
        .when(op == ">", value > low)
        .when(op == ">=", value >= low)
        .when(op == "between", inside)
        .when(op == "not between", ~inside)
    )
    return F.when(F.isnan(value), op.isin("!=", "not between")).otherwise(ordered)


def rule_holds(value: Column, rule: Rule) -> Column:
    """`holds` for one rule known when the query is written."""
    op, low, high, _ = rule.as_row()
    return holds(value, F.lit(op), F.lit(low), F.lit(high).cast("double"))


def _columns(name: str) -> tuple[Column, Column, Column]:
    return F.col(f"{name}_op"), F.col(f"{name}_low"), F.col(f"{name}_high")


def outcome_of(value: Column, error: Column | None = None) -> Column:
    """The outcome of a value under the rule columns of its row.

    An error comes first; no value is a failure; an expectation decides alone;
    otherwise the fail trigger is tested before the warn trigger.
    """
    expected = holds(value, *_columns("expect"))
    fires = {name: F.coalesce(holds(value, *_columns(name)), F.lit(False)) for name in ("fail", "warn")}
    judged = (
        F.when(value.isNull(), "fail")
        .when(F.col("expect_op").isNotNull(), F.when(expected, "pass").otherwise("fail"))
        .when(F.col("fail_op").isNotNull() & fires["fail"], "fail")
        .when(F.col("warn_op").isNotNull() & fires["warn"], "warn")
        .otherwise("pass")
    )
    return judged if error is None else F.when(error.isNotNull(), "error").otherwise(judged)


def message_of(value: Column, outcome: Column, detail: Column, error: Column) -> Column:
    """Why: the error, the rule that was broken or met, and the detail."""
    rule = (
        F.when(outcome == "warn", F.concat(F.lit(WARNED), F.col("warn_text")))
        .when(
            (outcome == "fail") & F.col("expect_op").isNotNull(),
            F.concat(F.lit(EXPECTED), F.col("expect_text")),
        )
        .when(outcome == "fail", F.concat(F.lit(FAILED), F.col("fail_text")))
    )
    said = F.concat_ws("; ", rule, detail)
    return (
        F.when(error.isNotNull(), error)
        .when(value.isNull(), F.coalesce(detail, F.lit(NO_VALUE)))
        .otherwise(F.when(said != "", said))
    )


def noun() -> Column:
    """What the count of a rule's metric counts, one and many."""
    return F.struct(F.col("noun_one").alias("singular"), F.col("noun_many").alias("plural"))


def display_value() -> Column:
    """A clause's value for people, in its unit; changes with their sign."""
    unit, value = F.col("unit"), F.col("value")
    plain = format_value(unit, value, noun())
    return F.when(F.col("change").isNull(), plain).otherwise(
        format_value(unit, value, noun(), signed=True)
    )


def judge(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """Clause results: each measured clause with its outcome and message."""
    value, detail, error = F.col("value"), F.col("detail"), F.col("error")
    judged = rules.join(measured, "clause_id", "left").withColumn(
        "outcome", outcome_of(value, error)
    )
    return judged.withColumn("message", message_of(value, F.col("outcome"), detail, error))


def fold_checks(clauses: DataFrame, *by: str) -> DataFrame:
    """Check results: the worst clause outcome, and the messages of its problems.

    A check of one clause carries that clause's value (and `display_value`) and message; several
    clauses are told as `key: message` in written order. A check's clauses are
    as many as its author wrote, so the list per check stays short.
    """
    by = by or ("check_id",)
    with_text = "display_value" in clauses.columns
    problem = F.when(
        severity(F.col("outcome")) > 0,
        F.struct(
            "position",
            F.concat(
                F.col("clause_key"), F.lit(": "), F.coalesce(F.col("message"), F.col("outcome"))
            ).alias("text"),
        ),
    )
    folded = clauses.groupBy(*by).agg(
        worst_outcome(F.col("outcome")).alias("outcome"),
        F.count(F.lit(1)).alias("clauses"),
        F.first("value").alias("one_value"),
        F.first("message").alias("one_message"),
        *([F.first("display_value").alias("one_shown")] if with_text else []),
        F.array_sort(F.collect_list(problem)).alias("problems"),
    )
    single = F.col("clauses") == 1
    shown = [F.when(single, F.col("one_shown")).otherwise("").alias("display_value")] if with_text else []
    several = F.array_join(F.transform("problems", lambda p: p["text"]), "; ")
    return folded.select(
        *by,
        "outcome",
        "clauses",
        F.when(single, F.col("one_value")).alias("value"),
        *shown,
        F.when(single, F.col("one_message"))
        .otherwise(F.when(several != "", several))
        .alias("message"),
    )


def run_outcome(outcome: Column, position: Column) -> Column:
    """Aggregate: the worst outcome; on a tie, the one recorded first."""
    return F.min_by(outcome, F.struct(-severity(outcome), position))


def run_rollup(
    results: DataFrame, by: str = "run_id", position: str = "position", fail_on: str = "fail"
) -> DataFrame:
    """Per run: counts per outcome, the worst outcome, and the exit code 0, 1 or 2."""
    if fail_on not in ("fail", "warn"):
        raise ValueError("fail_on must be fail or warn")
    outcome = F.col("outcome")
    known = results.withColumn("outcome", known_outcome(outcome))
    rolled = known.groupBy(by).agg(
        *outcome_counts(outcome), run_outcome(outcome, F.col(position)).alias("outcome")
    )
    failed = F.col("fail") > 0
    if fail_on == "warn":
        failed = failed | (F.col("warn") > 0)
    return rolled.withColumn(
        "exit_code", F.when(F.col("error") > 0, 2).when(failed, 1).otherwise(0)
    )
