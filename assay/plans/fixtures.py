"""Result tables derived from the given ones, by SQL both engines run unchanged.

Orders are runs, suppliers are checks, and what an order bought of a supplier
is that check's result in that run: the history grows with the tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assay.sources.results import settled

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CTES = {
    "checks": """
        select s_suppkey as check_id, s_name as name, substr(md5(s_name), 1, 16) as check_hash,
               concat('db.t', cast(n_nationkey as string)) as dataset,
               concat('ds', cast(n_regionkey as string)) as datasource,
               case when s_suppkey % 11 = 3 then 'retired'
                    when s_suppkey % 7 = 2 or n_nationkey = 4 then 'disabled'
                    else 'active' end as state,
               case when s_suppkey % 4 = 0 then null
                    else concat('Owner', cast(s_suppkey % 4 as string)) end as owner,
               case when s_suppkey % 5 = 0 then '' when s_suppkey % 5 = 1 then 'daily'
                    when s_suppkey % 5 = 2 then 'daily,Money' when s_suppkey % 5 = 3 then 'money,'
                    else concat('tag', cast(s_suppkey % 17 as string)) end as tag_text,
               concat('checks/ds', cast(n_regionkey as string), '/', lower(replace(n_name, ' ', '_')),
                      '/f', cast(s_suppkey % 3 as string), '.yml') as path,
               concat('sum(q) > ', cast((s_suppkey + 1998) % 5 as string)) as expression,
               timestamp '1995-01-01 00:00:00' + interval '1' day * (s_suppkey % 300)
                   as registered_at,
               timestamp '1995-01-01 00:00:00' + interval '1' day * (s_suppkey % 300 + s_suppkey % 3)
                   as state_since
        from supplier join nation on s_nationkey = n_nationkey""",
    "runs": """
        select o_orderkey as run_no, concat('r', lpad(cast(o_orderkey as string), 10, '0')) as run_id,
               case when o_orderkey % 10 = 9 then 'other' else 'main' end as project,
               o_orderdate + interval '1' hour * (o_orderkey % 24) as started_at,
               case when o_orderkey % 50 = 7 then null when o_orderstatus = 'F' then 1
                    else 0 end as exit_code,
               case when o_orderkey % 3 = 0
                    then concat('k', cast(o_custkey as string)) end as run_key
        from orders""",
    "results": """
        select g.result_id, g.run_no, g.run_id, g.check_id, g.outcome, g.qty, c.dataset, c.datasource, c.name,
               case when g.outcome in ('error', 'mystery') then null
                    else cast(g.qty as double) end as value,
               g.place as position, cast(g.qty * 10 as double) as duration_ms
        from (select l_orderkey * 1000000 + l_suppkey as result_id, l_orderkey as run_no,
                     concat('r', lpad(cast(l_orderkey as string), 10, '0')) as run_id,
                     l_suppkey as check_id, min(l_linenumber) * 1000000 + l_suppkey as place,
                     cast(sum(l_quantity) as bigint) as qty,
                     case (cast(sum(l_quantity) as bigint) * 7 + l_suppkey + l_orderkey) % 13
                          when 0 then 'error' when 1 then 'skipped' when 2 then 'skipped'
                          when 3 then 'fail' when 4 then 'fail' when 5 then 'fail'
                          when 6 then 'warn' when 7 then 'mystery' else 'pass' end as outcome
              from lineitem group by l_orderkey, l_suppkey) g
        join checks c on g.check_id = c.check_id""",
    "history": """
        select h.result_id, h.run_id, h.check_id, h.outcome, h.value, h.position, h.duration_ms,
               r.started_at, r.project, r.run_key, r.exit_code, h.datasource, h.name,
               case when h.check_id % 5 = 0 and extract(month from r.started_at) = 6
                    then 'db.old' else h.dataset end as dataset,
               concat('sum(q) > ', cast((extract(year from r.started_at) + h.check_id) % 5 as string))
                   as expression,
               case when h.qty % 17 = 0 then 'max' else 'sum' end as metric,
               case when extract(year from r.started_at) >= 1996
                    then cast((extract(month from r.started_at) + h.check_id) % 3 as int)
                    end as definition_version
        from results h join runs r on h.run_no = r.run_no""",
    "clause_history": """
        select check_id as clause_id, value as measured, metric, started_at, run_id, run_key
        from history""",
    "dataset_runs": """
        select run_id, datasource, dataset, max(started_at) + interval '5' minute as finished_at,
               case when max(case when outcome in ('error', 'mystery') then 1 else 0 end) = 1
                    then 'error'
                    when max(case when outcome = 'fail' then 1 else 0 end) = 1 then 'fail'
                    when max(case when outcome = 'warn' then 1 else 0 end) = 1 then 'warn'
                    else 'pass' end as outcome
        from history where result_id % 5 <> 0 group by run_id, datasource, dataset""",
    "deliveries": """
        select result_id as delivery_id, run_id, check_id,
               case when check_id % 2 = 0 then 'chat' else 'hook' end as notifier,
               case outcome when 'fail' then 'failing' when 'pass' then 'recovered'
                    else 'erroring' end as event,
               case when outcome = 'pass' then 'fail' end as previous_outcome,
               started_at as created_at, cast(value as bigint) % 7 as attempts,
               case when cast(value as bigint) % 3 = 0
                    then started_at + interval '1' hour end as sent_at,
               case when cast(value as bigint) % 3 = 1 and cast(value as bigint) % 5 = 0
                    then started_at + interval '2' day end as abandoned_at
        from history
        where outcome in ('fail', 'pass', 'warn') and run_key is not null""",
    "totals": """
        select r.run_id, r.project, r.started_at, r.exit_code,
               cast(count(*) as bigint) as total,
               cast(sum(case when outcome = 'pass' then 1 else 0 end) as bigint) as passed,
               cast(sum(case when outcome = 'warn' then 1 else 0 end) as bigint) as warned,
               cast(sum(case when outcome = 'fail' then 1 else 0 end) as bigint) as failed,
               cast(sum(case when outcome in ('error', 'mystery') then 1 else 0 end) as bigint)
                   as errored
        from results h join runs r on h.run_no = r.run_no
        group by r.run_id, r.project, r.started_at, r.exit_code""",
}
# What each is made from; a table's own name is a given table.
NEEDS = {
    "checks": (),
    "runs": (),
    "results": ("checks",),
    "history": ("results", "runs"),
    "clause_history": ("history",),
    "dataset_runs": ("history",),
    "deliveries": ("history",),
    "totals": ("results", "runs"),
}

# The state of every result of a history, in the oracle's SQL.
STATE = """
    known as (select *, case when outcome in ('pass', 'warn', 'fail', 'error', 'skipped')
                             then outcome else 'error' end as o from history),
    seen as (
        select *, o in ('pass', 'warn', 'fail') as is_eval,
               last_value(case when o in ('fail', 'pass') then o end ignore nulls) over prev as basis_alert,
               last_value(case when o <> 'skipped' then o end ignore nulls) over prev as basis_unskipped,
               last_value(case when o in ('pass', 'warn', 'fail') then o end ignore nulls) over prev as eval_prev,
               lag(o) over ord as raw_prev
        from known
        window ord as (partition by check_id order by started_at, run_id),
               prev as (partition by check_id order by started_at, run_id
                        rows between unbounded preceding and 1 preceding)),
    state as (
        select *,
               last_value(case when is_eval and o is distinct from eval_prev then started_at end
                          ignore nulls) over cur as eval_since,
               last_value(case when o is distinct from raw_prev then started_at end
                          ignore nulls) over cur as raw_since,
               last_value(case when is_eval then o end ignore nulls) over cur as eval_now,
               last_value(case when is_eval then started_at end ignore nulls) over cur as eval_at,
               row_number() over (partition by check_id order by started_at desc, run_id desc) as rn,
               case when o = 'fail' and basis_alert is distinct from 'fail' then 'failing'
                    when o = 'pass' and basis_alert = 'fail' then 'recovered'
                    when o = 'error' and basis_unskipped is distinct from 'error' then 'erroring'
                    end as event,
               case when o = 'error' then basis_unskipped else basis_alert end as previous_outcome
        from seen
        window cur as (partition by check_id order by started_at, run_id
                       rows between unbounded preceding and current row)),
    heads as (
        select check_id, result_id, run_id, started_at, o as outcome,
               case when is_eval then eval_since else raw_since end as since,
               case when not is_eval then eval_now end as last_outcome,
               case when not is_eval then eval_at end as last_started_at,
               case when not is_eval then eval_since end as last_since,
               case when o in ('fail', 'pass') then o else basis_alert end as basis_alert,
               case when o <> 'skipped' then o else basis_unskipped end as basis_unskipped
        from state where rn = 1)"""


def _order(names: tuple[str, ...], found: list[str]) -> list[str]:
    for name in names:
        _order(NEEDS[name], found)
        if name not in found:
            found.append(name)
    return found


def with_tables(*names: str, more: str = "") -> str:
    """A WITH clause of derived tables, for oracle SQL."""
    parts = [f"{name} as ({CTES[name]})" for name in _order(names, [])]
    return "with " + ", ".join([*parts, *([more] if more else [])]) + " "


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is inferred once, since each inference is a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# Lines of so many bytes of Parquet, some half a million, are grouped by one task.
TASK_BYTES = 8 << 20


def lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines dealt by order: grouped, and joined to their runs, where they are.

    Tasks get no more lines as the table grows, so none needs more memory for them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    tasks = system.getContentSummary(path).getLength() // TASK_BYTES + 1
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey")


def history_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the history, written out: for queries that read it more than once."""
    return settled(derived(spark, sf_dir, "history").select(*columns))


def run_text(number: Column) -> Column:
    """The id of a run from its number. Texts rank as the numbers do, and are longer to group by."""
    return F.concat(F.lit("r"), F.lpad(number.cast("string"), 10, "0"))


def derived(
    spark: SparkSession, sf_dir: str, name: str, given: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A derived table as a DataFrame; checks get their tags as an array.

    `given` holds derived tables that are there already, for queries that use one several times.
    """
    made = dict(given or {})

    def make(part: str) -> DataFrame:
        if part in made:
            return made[part]
        text = CTES[part]
        inputs = {t: table(spark, sf_dir, t) for t in TABLES if f"from {t} " in f"{text} " or f"join {t} " in f"{text} "}
        inputs = {t: df for t, df in inputs.items() if t not in NEEDS} | {t: make(t) for t in NEEDS[part]}
        if part == "results":
            # Written out, as Spark takes a join for as large as the product of its sides.
            checks = settled(inputs["checks"].select("check_id", "name", "dataset", "datasource"))
            inputs = {"lineitem": lines_by_order(spark, sf_dir), "checks": checks}
        for source in inputs:
            for word in ("from", "join"):
                text = text.replace(f"{word} {source} ", f"{word} {{{source}}} ")
                text = text.replace(f"{word} {source}\n", f"{word} {{{source}}}\n")
            if text.endswith(f"from {source}"):
                text = text.removesuffix(source) + f"{{{source}}}"
        made[part] = spark.sql(text, **inputs)
        return made[part]

    df = make(name)
    if name == "checks":
        tags = F.when(F.col("tag_text") == "", F.array().cast("array<string>"))
        df = df.withColumn("tags", tags.otherwise(F.split("tag_text", ",")))
    return df


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns to compare, times and arrays as text, whole numbers as bigint."""
    cells = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType.simpleString()
        cell = F.col(name)
        if kind.startswith("timestamp"):
            cell = cell.cast("string")
        elif kind == "array<string>":
            cell = F.array_join(cell, ",")
        elif kind in ("int", "smallint", "bigint"):
            cell = cell.cast("bigint")
        cells.append(cell.alias(name))
    return df.select(*cells)
