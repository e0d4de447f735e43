"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import outcomes, predicates, text, times
from assay.plans.fixtures import derived, shown, table, with_tables
from assay.plans.registry import query

SPACE = (
    r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


@query(
    "collapse_whitespace",
    f"""select doc_id, md5(t) as digest, length(t) as n from
        (select doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g'), ' ') as t from documents) d""",
)
def collapse_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    collapsed = text.collapse_whitespace(F.col("text"))
    digest = F.md5(collapsed.cast("binary")).alias("digest")
    return table(spark, sf, "documents").select(
        "doc_id", digest, F.length(collapsed).cast("bigint").alias("n")
    )


@query(
    "check_id",
    with_tables("checks")
    + """select check_id as row_id, substr(sha1(concat_ws(chr(0), 'check', datasource, dataset, name)), 1, 16) as id
         from checks""",
)
def check_id(spark: SparkSession, sf: str) -> DataFrame:
    made = text.check_id(F.col("datasource"), F.col("dataset"), F.col("name"))
    return derived(spark, sf, "checks").select(F.col("check_id").alias("row_id"), made.alias("id"))


@query(
    "clause_id",
    r"""select l_orderkey, l_linenumber, l_partkey, substr(sha1(concat_ws(chr(0), 'clause', l_orderkey, 'failed_rows',
               concat('flag = ', l_returnflag), concat('condition=qty < ', l_linenumber))), 1, 16) as id
        from lineitem""",
)
def clause_id(spark: SparkSession, sf: str) -> DataFrame:
    made = text.clause_id(
        F.col("l_orderkey").cast("string"),
        F.lit("failed_rows"),
        F.concat(F.lit("  flag  =\n"), "l_returnflag"),
        F.concat(F.lit("condition=qty   <  "), F.col("l_linenumber").cast("string")),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", made.alias("id")
    )


@query(
    "known_outcome",
    with_tables("results")
    + """select case when outcome in ('pass', 'warn', 'fail', 'error', 'skipped') then outcome else 'error' end as outcome,
                count(*) as n from results group by 1""",
)
def known_outcome(spark: SparkSession, sf: str) -> DataFrame:
    known = outcomes.known_outcome(F.col("outcome")).alias("outcome")
    return derived(spark, sf, "results").groupBy(known).agg(F.count(F.lit(1)).alias("n"))


@query(
    "known_state",
    with_tables("checks")
    + """select case when s in ('active', 'disabled') then s else 'retired' end as state, count(*) as n
         from (select case when check_id % 2 = 0 then state else concat(state, '2') end as s from checks) c group by 1""",
)
def known_state(spark: SparkSession, sf: str) -> DataFrame:
    written = F.when(F.col("check_id") % 2 == 0, F.col("state")).otherwise(
        F.concat("state", F.lit("2"))
    )
    known = outcomes.known_state(written).alias("state")
    return derived(spark, sf, "checks").groupBy(known).agg(F.count(F.lit(1)).alias("n"))


@query(
    "finite",
    """select event_id, case when event_id % 3 = 0 then value end as value from events""",
)
def finite(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("event_id") % 3
    endless = F.when(place == 1, F.lit(float("nan"))).when(place == 2, F.lit(float("-inf")))
    value = predicates.finite(F.coalesce(endless, F.col("value")))
    return table(spark, sf, "events").select("event_id", value.alias("value"))


@query(
    "to_utc",
    """select event_id, cast(date_trunc('second', ts) + interval 5 hour + interval 30 minute as varchar) as utc from events""",
)
def to_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Wall times of a zone 5½ hours behind UTC."""
    utc = times.to_utc(F.date_trunc("second", "ts").cast("timestamp_ntz"), "-05:30")
    return shown(table(spark, sf, "events").select("event_id", utc.alias("utc")))


@query(
    "table_ref",
    with_tables("checks")
    + """select check_id, case when check_id % 2 = 0 then 'db' when check_id % 3 = 0 then 'a.b' end as schema,
                concat('t', check_id) as "table" from checks""",
)
def table_ref(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("check_id")
    name = F.concat(
        F.when(number % 2 == 0, "db.").when(number % 3 == 0, "a.b.").otherwise(""),
        F.lit("t"),
        number.cast("string"),
    )
    schema, bare = text.table_ref(name)
    return derived(spark, sf, "checks").select("check_id", schema.alias("schema"), bare.alias("table"))


@query(
    "path_of_source",
    with_tables("checks")
    + "select check_id, concat('c:', path) as path from checks",
)
def path_of_source(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat_ws(":", F.lit("c"), "path", F.col("check_id").cast("string"), F.lit("5"))
    return derived(spark, sf, "checks").select(
        "check_id", text.path_of_source(source).alias("path")
    )


@query(
    "tags_none",
    with_tables("checks")
    + """select check_id, array_to_string(list_filter(string_split(tag_text, ','), lambda x: x <> ''), ',') as tags
         from checks""",
)
def tags_none(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array_join(text.tags_or_none(F.col("tags")), ",")
    return derived(spark, sf, "checks").select("check_id", tags.alias("tags"))


PARTS = "a // 86400 as d, a % 86400 // 3600 as h, a % 3600 // 60 as m, a % 60 as s"


@query(
    "format_duration",
    f"""select l_orderkey, l_linenumber, l_partkey, case when t < 0 then '-' else '' end || case when a = 0 then '0s' else
            array_to_string(list_filter([case when d > 0 then d || 'd' end, case when h > 0 then h || 'h' end,
                case when m > 0 then m || 'm' end, case when s > 0 then s || 's' end], lambda x: x is not null)[1:2], ' ') end as shown
        from (select *, {PARTS} from (select *, abs(t) as a from (select l_orderkey, l_linenumber, l_partkey,
              (l_partkey - 50) * (l_orderkey % 5) * (l_linenumber * l_linenumber + 11) as t from lineitem) x) y) z""",
)
def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    seconds = (F.col("l_partkey") - 50) * (F.col("l_orderkey") % 5) * (line * line + 11)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.format_duration(seconds.cast("double")).alias("shown"),
    )


NUMBERS = "(o_custkey % 60) * 0.125 - 2.5"


@query(
    "format_value",
    f"""select o_orderkey, case when k = 0 then '—'
              when k = 1 then format('{{:,}}', cast(c * 1000 as bigint)) || case when c * 1000 = 1 then ' row' else ' rows' end
              when k = 2 then format('{{:.2f}}%', v) when k = 3 then c || 's'
              when k = 4 then format('{{:.6g}}', v * 1000003) when k = 5 then format('{{:.6g}}', v / 100000)
              when k = 6 then case when v > 0 and format('{{:.2f}}', v) <> '0.00' then '+' else '' end || format('{{:.2f}}%', v)
              else format('{{:.2f}}%', o_totalprice / 1000) end as shown
       from (select o_orderkey, o_custkey % 60 as c, cast({NUMBERS} as double) as v, o_totalprice,
                    case when o_orderkey % 8 = 3 and o_custkey % 60 = 0 then 1 else o_orderkey % 8 end as k
             from orders) o""",
)
def format_value(spark: SparkSession, sf: str) -> DataFrame:
    count, number = F.col("o_custkey") % 60, F.expr(NUMBERS).cast("double")
    kind = F.col("o_orderkey") % 8
    kind = F.when((kind == 3) & (count == 0), 1).otherwise(kind)
    value = (
        F.when(kind == 0, F.lit(None).cast("double"))
        .when(kind == 1, count * 1000.0)
        .when(kind == 3, count.cast("double"))
        .when(kind == 4, number * 1000003)
        .when(kind == 5, number / 100000)
        .when(kind == 7, F.col("o_totalprice") / 1000)
        .otherwise(number)
    )
    unit = F.when(kind == 1, "count").when(kind.isin(2, 6, 7), "percent").when(kind == 3, "duration")
    unit = F.coalesce(unit, F.lit("number"))
    noun = F.struct(F.lit("row").alias("singular"), F.lit("rows").alias("plural"))
    signed = text.format_value(unit, value, noun, signed=True)
    told = F.when(kind == 6, signed).otherwise(text.format_value(unit, value, noun))
    return table(spark, sf, "orders").select("o_orderkey", told.alias("shown"))
