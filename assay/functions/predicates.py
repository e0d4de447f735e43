"""Row predicates of the metrics: scope, missing, valid and invalid values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE_VALUES = (str, int, float, Decimal, date, datetime, time)
VALIDITY_OPTIONS = (
    "valid_values",
    "valid_min",
    "valid_max",
    "valid_length",
    "valid_min_length",
    "valid_max_length",
    "valid_regex",
)


def sql_condition(text: str) -> Column:
    """A user's SQL condition as one operand; a trailing comment ends at the newline."""
    return F.expr(f"({text}\n)")


def value_in_list(column: Column, values: Iterable[Any]) -> Column:
    """`column IN values` without NULL items; never true for an empty list.

    A list holding any text is compared as text, so that no row's value is
    ever converted to a number.
    """
    kept = [v for v in values if v is not None]
    if not all(isinstance(v, SINGLE_VALUES) for v in kept):
        raise ValueError("a list item is not a single value")
    if not kept:
        return F.lit(False)
    if any(isinstance(v, str) for v in kept):
        return column.cast("string").isin([str(v) for v in kept])
    return column.isin(kept)


def missing(column: Column, missing_values: Iterable[Any] | None = None) -> Column:
    """NULL, or one of the values that stand for it."""
    listed = list(missing_values or ())
    return column.isNull() | value_in_list(column, listed) if listed else column.isNull()


def valid(column: Column, options: Mapping[str, Any]) -> Column:
    """Whether a value keeps every `valid_*` rule given."""
    length = F.length(column)
    rules = {
        "valid_values": lambda v: value_in_list(column, v),
        "valid_min": lambda v: column >= F.lit(v),
        "valid_max": lambda v: column <= F.lit(v),
        "valid_length": lambda v: length == v,
        "valid_min_length": lambda v: length >= v,
        "valid_max_length": lambda v: length <= v,
        "valid_regex": lambda v: column.rlike(v),
    }
    return reduce(and_, [rules[name](options[name]) for name in rules if name in options])


def invalid(column: Column, options: Mapping[str, Any]) -> Column:
    """Present, and breaking a rule: a missing value is never invalid."""
    return ~missing(column, options.get("missing_values")) & ~valid(column, options)


def scoped(predicate: Column, scope: Column | None) -> Column:
    return predicate if scope is None else scope & predicate


def scoped_value(value: Column, scope: Column | None) -> Column:
    """The value for rows in scope, else NULL: what MIN, MAX, AVG and SUM read."""
    return value if scope is None else F.when(scope, value)


def count_where(predicate: Column, scope: Column | None = None) -> Column:
    """Rows in scope matching a predicate; 0 on no rows."""
    return F.count_if(scoped(predicate, scope)).cast("double")


def rows_in(scope: Column | None) -> Column:
    counted = F.count(F.lit(1)) if scope is None else F.count_if(scope)
    return counted.cast("double")


def percent(part: Column, whole: Column) -> Column:
    """100·part/whole; 0 when there are no rows to speak of."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def finite(value: Column) -> Column:
    """A double with NaN and the infinities as NULL."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(F.isnan(value) | infinite, F.lit(None).cast("double")).otherwise(value)
