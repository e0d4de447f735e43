"""Running values over ordered rows that never put one hot key in one task.

A plain window over a key sorts and reads all of the key's rows in a single
task, so one check holding a third of a history is one straggler. Here the keys
are counted first. The rows of a key with very many are cut into spans of about
as many rows each, by their times: a window runs inside every span, and what a
span starts with is carried from the spans before it, of which there is one
summary row each. Every other key is one span, and nothing is carried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.times import micros
from assay.sources.results import cut_lineage

SPAN = "_span"
# A key with more rows than this is cut into spans.
HOT_ROWS = 1_000_000
# Into so many; only results of one and the same microsecond stay together.
SPANS = 256
# Keys are counted together by their hash, and alone only where so many rows have one.
GROUPS = 4096


@dataclass(frozen=True)
class HotKeys:
    """Every key to cut, with the times that end its spans; no table if none is hot."""

    cuts: DataFrame | None = None


#: For callers that know that no key has so many rows.
NONE_HOT = HotKeys()


def hot_keys(df: DataFrame, by: Sequence[str], time: str, hot_rows: int) -> HotKeys:
    """The keys with more rows than `hot_rows`: one counting job, and no more if there are none.

    A key has no more rows than all keys of its hash together, and of hashes there are few,
    so a task gives out few counts however many keys it has seen. Cuts are written out, as
    quantiles may differ when they are computed again.
    """
    n = F.count(F.lit(1)).alias("_n")
    group = F.pmod(F.hash(*by), F.lit(GROUPS))
    large = df.groupBy(group.alias("_group")).agg(n).where(F.col("_n") > hot_rows)
    groups = [r["_group"] for r in large.select("_group").collect()]  # at most GROUPS
    if not groups:
        return NONE_HOT
    counts = df.where(group.isin(*groups)).groupBy(*by).agg(n)
    if counts.agg(F.max("_n")).first()[0] <= hot_rows:
        return NONE_HOT
    at = micros(F.col(time), df.schema[time].dataType)
    hot = cut_lineage(counts.where(F.col("_n") > hot_rows).select(*by))
    shares = [i / SPANS for i in range(1, SPANS)]
    rows = df.join(hot, list(by), "left_semi")
    cuts = rows.groupBy(*by).agg(F.percentile_approx(at, shares, 10_000).alias("_cuts"))
    return HotKeys(cut_lineage(cuts))


def with_spans(df: DataFrame, by: Sequence[str], time: str, hot: HotKeys, how: str) -> DataFrame:
    """Rows with the number of their span: 1 and up for hot keys, else 0.

    `how` joins the cuts: "left" keeps all rows, "inner" those of hot keys alone.
    """
    if hot.cuts is None:
        rows = df.withColumn(SPAN, F.lit(0))
        return rows if how == "left" else rows.limit(0)
    at = micros(F.col(time), df.schema[time].dataType)
    joined = df.withColumn("_at", at).join(hot.cuts, list(by), how)
    span = F.size(F.filter("_cuts", lambda cut: cut < F.col("_at"))) + 1
    number = F.when(F.col("_cuts").isNull(), 0).otherwise(span)
    return joined.withColumn(SPAN, number).drop("_cuts", "_at")


def _spans(by: Sequence[str], hot: HotKeys) -> list[str]:
    """What windows lie within: with no hot key each key is one, and is not dealt by its span besides."""
    return list(by) if hot.cuts is None else [*by, SPAN]


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    newest: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add running columns over the rows before each row of its key.

    `newest` keeps the newest non-NULL value of an expression, `totals` its
    sum; `inclusive` counts the row itself too. `order` starts with the time
    hot keys are cut by and must be unique within a key. Given the `hot` keys,
    the span stays in the result, for what follows in the same spans.
    """
    newest, totals = dict(newest or {}), dict(totals or {})
    values = {f"_v_{name}": value for name, value in {**newest, **totals}.items()}
    kept = df.columns if hot is None else [*df.columns, SPAN]
    hot = hot_keys(df, by, order[0], hot_rows) if hot is None else hot
    at = F.struct(*order)

    def local(name: str) -> Column:
        value = F.col(f"_v_{name}")
        return F.last(value, ignorenulls=True) if name in newest else F.sum(value)

    def end(name: str) -> Column:
        value = F.col(f"_v_{name}")
        return F.max_by(value, F.when(value.isNotNull(), at)) if name in newest else F.sum(value)

    def carry(name: str) -> Column:
        value = F.col(f"_e_{name}")
        return F.last(value, ignorenulls=True) if name in newest else F.sum(value)

    names = [*newest, *totals]
    cut = hot.cuts is not None
    inside = Window.partitionBy(*_spans(by, hot)).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = with_spans(df.withColumns(values), by, order[0], hot, "left")
    rows = rows.withColumns({f"_w_{n}": local(n).over(frame) for n in names})
    if not cut:
        alone = {n: F.col(f"_w_{n}") for n in newest}
        alone |= {n: F.coalesce(f"_w_{n}", F.lit(0)) for n in totals}
        return rows.select(*kept, *[column.alias(n) for n, column in alone.items()])
    ends = (
        with_spans(df.withColumns(values), by, order[0], hot, "inner")
        .groupBy(*by, SPAN)
        .agg(*[end(n).alias(f"_e_{n}") for n in names])
    )
    earlier = Window.partitionBy(*by).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, SPAN, *[carry(n).over(earlier).alias(f"_c_{n}") for n in names])
    joined = rows.join(carried, [*by, SPAN], "left")
    out = {n: F.coalesce(f"_w_{n}", f"_c_{n}") for n in newest}
    for n in totals:
        out[n] = F.coalesce(f"_w_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))
    return joined.select(*kept, *[column.alias(n) for n, column in out.items()])


def followed(
    df: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[str], hot: HotKeys
) -> DataFrame:
    """Add the place in `order` of the row after each row of its key, as `names`; NULL after the last."""
    inside = Window.partitionBy(*_spans(by, hot)).orderBy(*order)
    next_of = dict(zip(names, order, strict=True))
    rows = with_spans(df, by, order[0], hot, "left")
    rows = rows.withColumns({name: F.lead(column).over(inside) for name, column in next_of.items()})
    if hot.cuts is None:
        return rows.drop(SPAN)
    starts = with_spans(df, by, order[0], hot, "inner").groupBy(*by, SPAN)
    starts = starts.agg(F.min(F.struct(*order)).alias("_start"))
    later = F.lead("_start").over(Window.partitionBy(*by).orderBy(SPAN))
    joined = rows.join(starts.select(*by, SPAN, later.alias("_later")), [*by, SPAN], "left")
    last = F.col(names[-1]).isNull()
    held = [name for name in rows.columns if name != SPAN and name not in next_of]
    ends = {name: F.when(last, F.col("_later")[column]).otherwise(F.col(name)) for name, column in next_of.items()}
    return joined.select(*held, *[column.alias(name) for name, column in ends.items()])


def numbered(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, hot: HotKeys
) -> DataFrame:
    """Number each key's rows from 1, over rows that kept their span.

    A window numbers them inside a span, without another shuffle; only spans
    of hot keys have others before them to count.
    """
    inside = Window.partitionBy(*_spans(by, hot)).orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    if hot.cuts is None:
        return rows.withColumn(name, F.row_number().over(inside).cast("long")).drop(SPAN)
    of_hot = rows.join(hot.cuts.select(*by), list(by), "left_semi")
    sizes = of_hot.groupBy(*by, SPAN).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*by, SPAN, F.sum("_n").over(earlier).alias("_before"))
    joined = rows.withColumn("_i", F.row_number().over(inside)).join(before, [*by, SPAN], "left")
    out = (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long")
    return joined.withColumn(name, out).drop(SPAN, "_i", "_before")


def newest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The `n` newest rows of each key with their `rank`, 1 for the newest.

    Every task keeps only its own `n` newest rows of a key before the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def newest_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, found by an aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return df.groupBy(*by).agg(top).select(*by, *[F.col(f"_top.{c}").alias(c) for c in rest])
