"""URL rules, and block decisions carried to aliases.

A rule names a host and the start of a path; it fits the host and its
subdomains, and of the fitting rules the longest wins. Urls that redirect or
name a canonical form are aliases: components over those edges carry a block to
every member. An explicit rule on a url itself, allow above all, comes first, so
an allowed url stays allowed in a blocked component.

* Null urls, or urls without `://`, have an empty host and path, fit no rule,
  have no aliases and are allowed.
* Edges come from every `<link rel="canonical" href=...>` and
  `<meta http-equiv="refresh" content="...url=...">` of a page. `&amp;` in them is
  decoded. Targets relative to the page's url, by `//host`, `/path`, `?query` or a
  path with or without dots, are resolved against it as in RFC 3986, those of pages
  with a `<base href=...>` against that. Targets of other schemes (`mailto:`),
  relative ones of pages without a host, null pages and pages without such a tag
  give none.
* Repeated urls are judged alike; a url that only occurs as a target counts for
  its component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, lower_ascii
from assay.llm.components import components

#: (verdict, host and path)
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first `://`, else null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = lower_ascii(F.regexp_substr(after_scheme(url), F.lit(r"^[^/?#]*")))
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    longest = F.lit(None).cast("string")
    for _verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        longest = F.when(inside & path.startswith(f"/{start}"), rule).otherwise(longest)
    return longest


def node_of(url: Column) -> Column:
    """A url without scheme and fragment, host in lower case: what aliases are told by."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), rest)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its `.` and `..` segments."""

    def stepped(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    # What ends in dots is a folder.
    ended = F.regexp_replace(path, r"(/\.\.?)$", "$1/")
    parts = F.split(F.substr(ended, F.lit(2)), "/")
    none = F.array().cast("array<string>")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, stepped), "/"))


def resolved(ends: DataFrame, target: str, rest: str) -> DataFrame:
    """`ends` with `node`: that of a target seen on a page; null if it has none.

    `rest` names what follows the scheme of the page's url. What several columns
    need is a column first, so that no expression is repeated.
    """
    said, columns = F.col(target), [F.col(c) for c in ends.columns]
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("_host")
    parts = ends.select(
        *columns,
        host,
        F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1).alias("_own"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("_page"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*/)", 1).alias("_folder"),
        F.regexp_extract(said, r"^[^?#]*", 0).alias("_path"),
        F.regexp_extract(said, r"^[^?#]*([^#]*)", 1).alias("_query"),
        F.when(said.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), node_of(said))
        .when(said.startswith("//"), node_of(F.concat(F.lit(":"), said)))
        .alias("_there"),
        said.rlike(r"^(//|[A-Za-z][A-Za-z0-9+.-]*:)").alias("_away"),
    )
    folder = F.when(F.col("_folder") == "", "/").otherwise(F.col("_folder"))
    whole = F.when(F.col("_path").startswith("/"), "").otherwise(folder)
    parts = parts.withColumn("_whole", F.concat(whole, "_path"))
    parts = parts.withColumn("_plain", without_dots(F.col("_whole")))
    inside = (
        F.when((F.col("_path") == "") & (F.col("_query") == ""), F.col("_own"))
        .when(F.col("_path") == "", F.concat("_page", "_query"))
        .otherwise(F.concat("_plain", "_query"))
    )
    here = F.when(~F.col("_away") & (F.col("_host") != ""), F.concat("_host", inside))
    parts = parts.withColumn("_node", F.coalesce("_there", here))
    return parts.select(*columns, F.when(F.col("_node").rlike("^[^/?]"), F.col("_node")).alias("node"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: urls as nodes, from canonical links and refreshes in the pages."""
    html = F.col("html")

    def tags(pattern: str) -> Column:
        return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))

    def target(tag: Column, name: str) -> Column:
        decoded = F.regexp_replace(tag, r"(?i)&(?:amp|#0*38|#x0*26);", "&")
        return F.regexp_extract(decoded, rf"(?i)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)

    links = tags(r"(?i)<link\b(?=[^>]*\brel=[\"']?canonical\b)[^>]*>")
    metas = tags(r"(?i)<meta\b(?=[^>]*\bhttp-equiv=[\"']?refresh\b)[^>]*>")
    targets = F.concat(
        F.transform(links, lambda tag: target(tag, "href")),
        F.transform(metas, lambda tag: target(tag, "url")),
    )
    base = target(F.regexp_extract(html, r"(?i)<base\b[^>]*>", 0), "href")
    found = pages.where(F.contains("url", F.lit("://"))).select(
        node_of(F.col("url")).alias("a"),
        after_scheme(F.col("url")).alias("rest"),
        base.alias("base"),
        F.explode(targets).alias("target"),
    )
    # Few pages have targets; written out, what follows is planned apart.
    found = cut_lineage(found.where("target <> ''"))
    based = resolved(found, "base", "rest")
    seen = F.when(F.col("base") == "", F.col("rest")).otherwise(F.coalesce("node", "rest"))
    ends = based.select("a", seen.alias("rest"), "target")
    return resolved(ends, "target", "rest").where("node is not null").select("a", F.col("node").alias("b"))


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    edges: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of: a row for every page.

    `edges` (a, b as nodes) are added to those found in the pages, for redirects
    seen while crawling.
    """
    links = alias_edges(pages)
    links = cut_lineage(links if edges is None else links.unionByName(edges))
    member = components(links)
    slash = F.locate("/", F.col("node"))
    host = F.when(slash > 0, F.substring_index("node", "/", 1)).otherwise(
        F.regexp_substr("node", F.lit(r"^[^?]*"))
    )
    path = F.regexp_substr(F.substr("node", F.length(host) + 1), F.lit(r"^[^?]*"))
    blocks = [rule for verdict, rule in rules if verdict == "block"]
    rule = rule_of(host, F.coalesce(path, F.lit("")), rules)
    blocked = F.coalesce(rule.isin(blocks), F.lit(False)) if blocks else F.lit(False)
    spread = member.groupBy("component").agg(F.max(blocked).alias("spread"))
    member = member.join(spread, "component")

    own_host, own_path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select(
        "page_id",
        own_host.alias("host"),
        own_path.alias("path"),
        F.when(F.contains("url", F.lit("://")), node_of(F.col("url"))).alias("node"),
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.when(F.col("rule").isin(blocks), "block").otherwise("allow")
    aliased = F.when(F.col("spread"), "block").otherwise("allow")
    return own.join(member, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), ruled).otherwise(aliased).alias("verdict"),
        F.col("component").alias("alias_of"),
    )
