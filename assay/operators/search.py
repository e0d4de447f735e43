"""Choosing checks: selection to run, search, and facets with their counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.rows import literal_rows
from assay.functions.text import tags_or_none
from assay.operators.rollups import status

FACETS = ("tag", "owner", "datasource", "dataset")
GLOB_MARKS = re.compile(r"[*?\[\]]")
TOP_VALUES = 10


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def glob_to_regex(pattern: str) -> str:
    """A file glob as an anchored regex; `*` crosses folders, as `fnmatch` does."""
    marks = {"*": ".*", "?": "."}
    pieces = re.split(r"(\[!?\]?[^\]]*\]|\*|\?)", pattern)
    regex = [
        marks.get(p) or (p.replace("[!", "[^", 1) if p.startswith("[") else re.escape(p))
        for p in pieces
    ]
    return f"(?s)^{''.join(regex)}$"


def under(path: str) -> Column:
    """Files at or below a path; the empty path and `.` mean the whole project."""
    root = path.rstrip("/")
    if root in ("", "."):
        return F.lit(True)
    return (F.col("path") == root) | F.col("path").startswith(root + "/")


def excluded(pattern: str) -> Column:
    """What an exclusion takes away: nothing if it is empty, all if it is `.`."""
    if not pattern.strip("/"):
        return F.lit(False)
    if GLOB_MARKS.search(pattern):
        return F.col("path").rlike(glob_to_regex(pattern))
    return under(pattern)


def select_checks(
    checks: DataFrame,
    *,
    paths: Sequence[str] = (),
    tags: Sequence[str] = (),
    datasources: Sequence[str] = (),
    excludes: Sequence[str] = (),
    named: Sequence[str] = (),
    include_disabled: bool = False,
) -> DataFrame:
    """Checks that meet every kind of condition given, by any one item of it.

    Names win over ids: an item of `named` is tried as the start of an id only
    where no check is called that.
    """
    chosen = [] if include_disabled else [F.col("state") == "active"]
    if paths:
        chosen.append(any_of([under(p) for p in paths]))
    if tags:
        chosen.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if datasources:
        chosen.append(F.col("datasource").isin(*datasources))
    if excludes:
        chosen.append(~any_of([excluded(p) for p in excludes]))
    if named:
        wanted = F.when(F.col("name").isin(*named), F.col("name"))
        names = checks.agg(F.collect_set(wanted).alias("names")).scalar()
        chosen.append(
            any_of(
                [
                    F.when(F.array_contains(names, item), F.col("name") == item).otherwise(
                        F.col("check_hash").startswith(item)
                    )
                    for item in named
                ]
            )
        )
    return checks.where(reduce(and_, chosen)) if chosen else checks


def checks_by_state_outcome(
    checks: DataFrame,
    states: Sequence[str] = ("active", "disabled"),
    outcomes: Sequence[str] = (),
) -> DataFrame:
    """Checks in some lifecycle states whose newest outcome is wanted; a check
    that never ran counts as `not_run`."""
    found = checks.where(F.col("state").isin(*states))
    if not outcomes:
        return found
    return found.where(F.coalesce("outcome", F.lit("not_run")).isin(*outcomes))


SEARCHED = ("name", "expression", "dataset", "path", "check_hash", "datasource", "owner")


def matches_text(needle: str) -> Column:
    """Whether a check's tags or text fields hold the needle, in any case of letters."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    fields = [F.contains(F.lower(F.col(name)), F.lit(needle)) for name in SEARCHED]
    in_tag = F.exists("tags", lambda tag: F.contains(F.lower(tag), F.lit(needle)))
    return F.coalesce(any_of([F.coalesce(f, F.lit(False)) for f in [*fields, in_tag]]), F.lit(False))


def search_checks(checks: DataFrame, needle: str) -> DataFrame:
    return checks.where(matches_text(needle))


def values_of(facet: str) -> Column:
    """A check's values of a facet as an array; the empty text means `none`."""
    if facet == "tag":
        return tags_or_none(F.col("tags"))
    return F.array(F.coalesce(F.col(facet), F.lit("")))


def facet_condition(
    needle: str = "",
    statuses: Sequence[str] = (),
    chosen: Mapping[str, Sequence[str]] | None = None,
    without: str | None = None,
) -> Column:
    """The search and every filter together; `without` leaves one facet out."""
    conditions = [matches_text(needle)]
    if statuses and without != "status":
        conditions.append(status().isin(*statuses))
    for facet, values in (chosen or {}).items():
        if values and facet != without:
            wanted = F.array(*[F.lit(v) for v in values])
            conditions.append(F.arrays_overlap(values_of(facet), wanted))
    return reduce(and_, conditions)


def facet_filter(checks: DataFrame, **query: object) -> DataFrame:
    """Checks matching a text, statuses and facet values, OR within, AND across."""
    return checks.where(facet_condition(**query))


def facet_counts(checks: DataFrame, facet: str, **query: object) -> DataFrame:
    """How many checks have each value of a facet, the facet's own filter aside.

    Values that only filtered-out checks have, or no check at all but the filter
    names, count 0.
    """
    matching = facet_condition(**query, without=facet)
    values = F.explode(F.array_distinct(values_of(facet))).alias("value")
    found = checks.select(matching.alias("matching"), values)
    ticked = sorted(set((query.get("chosen") or {}).get(facet, ())))
    if ticked:
        named = literal_rows(checks.sparkSession, "value string", [(v,) for v in ticked])
        found = found.unionByName(named.select(F.lit(False).alias("matching"), "value"))
    return found.groupBy("value").agg(F.count_if("matching").alias("checks"))


def all_facet_counts(
    checks: DataFrame,
    facets: Sequence[str] = FACETS,
    *,
    needle: str = "",
    statuses: Sequence[str] = (),
    chosen: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """`facet, value, checks` of several facets as `facet_counts` gives each, in one pass.

    A check gets a bit for every filter it misses. It counts for a facet if it misses
    none, or that facet's own alone.
    """
    chosen = {f: values for f, values in (chosen or {}).items() if values}
    bits = {facet: 1 << i for i, facet in enumerate(chosen)}
    missed = F.lit(0)
    for facet, values in chosen.items():
        wanted = F.array(*[F.lit(v) for v in values])
        missed = missed + F.when(F.arrays_overlap(values_of(facet), wanted), 0).otherwise(bits[facet])
    # A check that misses the search or a status counts nowhere, but its values are listed.
    inside = F.coalesce(facet_condition(needle, statuses), F.lit(False))
    marked = checks.withColumn("_missed", F.when(inside, missed).otherwise(-1))

    def listed(facet: str) -> Column:
        counts = F.col("_missed").isin(0, bits[facet]) if facet in bits else F.col("_missed") == 0
        return F.transform(
            F.array_distinct(values_of(facet)),
            lambda value: F.struct(F.lit(facet).alias("facet"), value.alias("value"), counts.alias("counts")),
        )

    rows = F.inline(F.flatten(F.array(*[listed(facet) for facet in facets])))
    found = marked.select(rows)
    named = [(f, v, False) for f in facets for v in sorted(set(chosen.get(f, ())))]
    if named:
        found = found.unionByName(
            literal_rows(checks.sparkSession, "facet string, value string, counts boolean", named)
        )
    return found.groupBy("facet", "value").agg(F.count_if("counts").alias("checks"))


def top_values(
    counts: DataFrame, limit: int = TOP_VALUES, ticked: Sequence[str] = ()
) -> DataFrame:
    """The values with the highest counts, ties by name, `none` last.

    Ticked values stay in the list wherever they rank.
    """
    blank = F.col("value") == ""
    order = [F.col("checks").desc(), blank, F.lower("value"), F.col("value")]
    top = counts.orderBy(*order).limit(limit)
    if not ticked:
        return top
    extra = counts.where(F.col("value").isin(*ticked))
    return top.unionByName(extra).distinct().orderBy(*order)
