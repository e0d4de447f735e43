"""Text columns: ids, paths, tags and values shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space in Unicode text.
SPACES = (
    r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]+"
)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def hash_of(*parts: Column) -> Column:
    """16 hex digits of the sha1 of NUL-joined parts."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 16)


def check_id(datasource: Column, dataset: Column, name: Column) -> Column:
    return hash_of(F.lit("check"), datasource, dataset, name)


def clause_id(check: Column, key: Column, where: Column, *identity: Column) -> Column:
    """`identity` holds `option=text` columns of the options that are SQL."""
    scope = F.coalesce(collapse_whitespace(where), F.lit(""))
    return hash_of(F.lit("clause"), check, key, scope, *map(collapse_whitespace, identity))


def table_ref(name: Column) -> tuple[Column, Column]:
    """(schema or NULL, table) of a name, split at its last dot."""
    table = F.substring_index(name, ".", -1)
    rest = F.length(name) - F.length(table) - 1
    return F.when(rest > 0, F.substring(name, F.lit(1), rest)), table


def path_of_source(source: Column) -> Column:
    """The path of `path:line:column`; the path may hold a colon."""
    return F.regexp_replace(source, r":[^:]*:[^:]*$", "")


def tags_or_none(tags: Column) -> Column:
    """A check's tags without blanks; one empty tag, `none`, when it has none."""
    kept = F.filter(tags, lambda tag: tag != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def folder_parts(path: Column) -> Column:
    """The folders of a file's path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def shared_prefix(first: Column, last: Column) -> Column:
    """The leading items two arrays share."""
    both = F.zip_with(first, last, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(both, False)
    return F.when(stop > 0, F.slice(first, F.lit(1), (stop - 1).cast("int"))).otherwise(first)


def format_duration(seconds: Column) -> Column:
    """At most two units, largest first: `2h 12m`, `-7h`, `0s`."""
    total = F.bround(F.abs(seconds), 0).cast("long")
    amounts = {
        "d": F.floor(total / 86400),
        "h": F.floor(total % 86400 / 3600),
        "m": F.floor(total % 3600 / 60),
        "s": total % 60,
    }
    shown, larger = [], F.lit(0)
    for unit, amount in amounts.items():
        text = F.concat(amount.cast("string"), F.lit(unit))
        shown.append(F.when((amount > 0) & (larger < 2), text))
        larger = larger + F.when(amount > 0, 1).otherwise(0)
    sign = F.when((seconds < 0) & (total > 0), "-").otherwise("")
    words = F.concat(sign, F.concat_ws(" ", *shown))
    return F.when(total == 0, F.when(seconds < 0, "-0s").otherwise("0s")).otherwise(words)


def two_decimals(value: Column) -> Column:
    """A number with two decimals, rounded as the binary number it is, ties to even.

    The part after the point is taken in steps of 2^-52, as whole numbers that
    do not round. Numbers too large for that have no decimals to round.
    """
    size = F.abs(value)
    whole = F.floor(size)
    rest = (size - whole) * F.lit(float(2**52))
    steps = F.floor(rest)
    beyond = rest != steps
    hundred = steps * 100
    cents = F.shiftright(hundred, 52)
    left = hundred - F.shiftleft(cents, 52)
    half = F.lit(2**51)
    up = (left > half) | ((left == half) & (beyond | (cents % 2 == 1)))
    total = whole * 100 + cents + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    text = F.concat(
        sign,
        F.floor(total / 100).cast("string"),
        F.lit("."),
        F.lpad((total % 100).cast("string"), 2, "0"),
    )
    return F.when(size < 1e13, text).otherwise(F.format_string("%.2f", value))


def format_value(
    unit: Column, value: Column, noun: Column | None = None, signed: bool = False
) -> Column:
    """Text of a value column: whole counts, two decimals of percents, durations in units, else six digits.

    NULL becomes a dash. The field of `noun` that fits, `singular` or `plural`, follows a count.
    With `signed`, texts with any digit but 0 get a plus if the value is above 0.
    """
    whole = F.bround(value, 0)
    count = F.format_number(whole, 0)
    if noun is not None:
        word = F.when(whole == 1, noun["singular"]).otherwise(noun["plural"])
        count = F.when(word.isNotNull(), F.concat_ws(" ", count, word)).otherwise(count)
    number = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(e|$)", "$1$2")
    shown = (
        F.when(value.isNull(), "—")
        .when(unit == "count", count)
        .when(unit == "percent", F.concat(two_decimals(value), F.lit("%")))
        .when(unit == "duration", format_duration(value))
        .otherwise(F.regexp_replace(number, r"\.(e|$)", "$1"))
    )
    if not signed:
        return shown
    rise = (value > 0) & shown.rlike("[1-9]")
    return F.when(rise, F.concat(F.lit("+"), shown)).otherwise(shown)
