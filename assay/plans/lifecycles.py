"""Queries of check lifecycle, definitions, resumed runs and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import alerts, lifecycle, resume, state
from assay.plans.fixtures import STATE, derived, history_rows, lines_by_order, shown, with_tables
from assay.plans.histories import VERSIONS, versions_of
from assay.plans.registry import query

SYNCED_AT = "2024-01-01 00:00:00"
KNOWN, FOUND = "check_id % 10 <> 4", "check_id % 9 <> 5"


def both_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A registry missing some checks, and loaded checks missing others."""
    checks = derived(spark, sf, "checks")
    loaded = checks.where(FOUND).withColumn("enabled", F.col("check_id") % 8 != 0)
    return checks.where(KNOWN), loaded


SYNC = f"""sides as (select c.check_id, c.dataset, case when {KNOWN} then state end as was, state_since,
        case when not ({FOUND}) then 'retired' when check_id % 8 <> 0 then 'active' else 'disabled' end as wanted
        from checks c where {KNOWN} or {FOUND})"""
CHANGED = """case when was is null then 'added' when was = wanted then null when wanted = 'retired' then 'retired'
    when was = 'retired' then 'returned' when wanted = 'active' then 'enabled' else 'disabled' end"""


@query(
    "registry_sync",
    with_tables("checks", more=SYNC)
    + f"""select check_id, dataset, wanted as state, cast(case when was = wanted then state_since
               else timestamp '{SYNCED_AT}' end as varchar) as state_since, {CHANGED} as changed from sides""",
)
def registry_sync(spark: SparkSession, sf: str) -> DataFrame:
    registry, loaded = both_sides(spark, sf)
    synced = lifecycle.registry_sync(registry, loaded, F.expr(f"timestamp_ntz '{SYNCED_AT}'"))
    return shown(synced, "check_id", "dataset", "state", "state_since", "changed")


@query(
    "join_registry_sync",
    with_tables("checks", more=SYNC)
    + f"select coalesce({CHANGED}, 'unchanged') as changed, count(*) as checks from sides group by 1",
)
def join_registry_sync(spark: SparkSession, sf: str) -> DataFrame:
    registry, loaded = both_sides(spark, sf)
    synced = lifecycle.registry_sync(registry, loaded, F.expr(f"timestamp_ntz '{SYNCED_AT}'"))
    changed = F.coalesce("changed", F.lit("unchanged")).alias("changed")
    return synced.groupBy(changed).agg(F.count(F.lit(1)).alias("checks"))


@query(
    "retire_set",
    with_tables("checks")
    + f"select check_id from checks where {KNOWN} and not ({FOUND}) and state <> 'retired'",
)
def retire_set(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.retire_set(*both_sides(spark, sf)).select("check_id")


@query(
    "register_on_result",
    with_tables("history", "checks")
    + f"""select c.check_id, case when r.check_id is not null then 'active' else c.state end as state,
              cast(case when r.check_id is not null and not (coalesce({KNOWN.replace('check_id', 'c.check_id')}, false) and c.state = 'active')
                   then timestamp '{SYNCED_AT}' else c.state_since end as varchar) as state_since
          from checks c left join (select distinct check_id from history) r
              on r.check_id = c.check_id
          where {KNOWN.replace('check_id', 'c.check_id')} or r.check_id is not null""",
)
def register_on_result(spark: SparkSession, sf: str) -> DataFrame:
    registry, _ = both_sides(spark, sf)
    results = derived(spark, sf, "history")
    now = F.expr(f"timestamp_ntz '{SYNCED_AT}'")
    after = lifecycle.register_on_result(
        registry.select("check_id", "name", "dataset", "datasource", "state", "state_since"), results, now
    )
    return shown(after, "check_id", "state", "state_since")


@query(
    "definition_versions",
    with_tables("history", more=VERSIONS)
    + """select check_id, version, fingerprint, cast(recorded_at as varchar) as recorded_at, run_id
         from versions""",
)
def definition_versions(spark: SparkSession, sf: str) -> DataFrame:
    return shown(versions_of(spark, sf))


def definitions(spark: SparkSession, sf: str, shift: int, every: bool = False) -> DataFrame:
    """Each order as a check whose lines are its clauses.

    `shift` changes, adds and drops some clauses (none are dropped if `every` is
    set), and turns their order round. An order has at most seven lines.
    """
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    kept = lines_by_order(spark, sf)
    kept = kept if every else kept.where((F.col("l_partkey") + shift) % 6 != 0)
    lines = kept.groupBy(key, line).agg(
        F.max("l_quantity").alias("most"), F.max("l_returnflag").alias("flag")
    )
    moved = F.when((key + line * shift) % 4 == 1, F.col("most") + shift).otherwise(F.col("most"))
    place = -line if shift else line
    item = F.struct(
        place.alias("place"), line.alias("line"), moved.cast("bigint").alias("most"), "flag"
    )

    def clause(item: Column) -> Column:
        options = {"condition": "a  <  b", "valid_regex": "a  b"}
        return F.struct(
            F.concat(F.lit("line"), item["line"].cast("string")).alias("key"),
            F.concat(F.lit("q < "), item["most"].cast("string")).alias("expression"),
            F.concat(F.lit(" flag  = "), item["flag"]).alias("where"),
            F.create_map(*[F.lit(x) for pair in options.items() for x in pair]).alias("options"),
            F.array(F.lit("condition")).alias("sql_options"),
        )

    return (
        lines.groupBy(key.alias("check_id"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("check_id", F.transform("items", clause).alias("clauses"))
    )


def lines_sql(shift: int, every: bool = False) -> str:
    kept = "true" if every else f"(l_partkey + {shift}) % 6 <> 0"
    return f"""(select l_orderkey as check_id, concat('line', l_linenumber) as key,
        concat('q < ', cast(case when (l_orderkey + l_linenumber * {shift}) % 4 = 1 then max(l_quantity) + {shift}
               else max(l_quantity) end as bigint)) as expression, max(l_returnflag) as flag
        from lineitem where {kept} group by l_orderkey, l_linenumber)"""


@query(
    "definition_diff",
    f"""select coalesce(a.check_id, b.check_id) as check_id, coalesce(a.key, b.key) as key,
               case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as kind
        from {lines_sql(0)} a full join {lines_sql(1)} b on a.check_id = b.check_id and a.key = b.key
        where a.key is null or b.key is null or a.expression <> b.expression or a.flag <> b.flag""",
)
def definition_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = definitions(spark, sf, 0), definitions(spark, sf, 1)
    return lifecycle.definition_diff(before, after).select("check_id", "key", "kind")


@query(
    "definition_fingerprint",
    f"""select a.check_id, a.all_lines = b.all_lines as same from
            (select check_id, string_agg(key || expression || flag, ',' order by key) as all_lines from {lines_sql(0, True)} x group by 1) a
            join (select check_id, string_agg(key || expression || flag, ',' order by key) as all_lines from {lines_sql(1, True)} x group by 1) b
            on a.check_id = b.check_id""",
)
def definition_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Which checks keep their fingerprint when some clauses change, the others
    are put in another order and their SQL is spaced anew."""

    def prints(shift: int, name: str) -> DataFrame:
        rows = definitions(spark, sf, shift, True)
        if shift:
            respaced = lambda c: c.withField("where", F.regexp_replace(c["where"], " +", "   "))
            rows = rows.withColumn("clauses", F.transform("clauses", respaced))
        return rows.select("check_id", lifecycle.definition_fingerprint(F.col("clauses")).alias(name))

    both = prints(0, "a").join(prints(1, "b"), "check_id")
    return both.select("check_id", (F.col("a") == F.col("b")).alias("same"))


@query(
    "check_changes",
    with_tables("history", "checks", more=VERSIONS)
    + """, every as (select check_id, 'added' as kind, registered_at as at, null as version, 0 as step from checks
            union all select check_id, case state when 'active' then 'enabled' else state end, state_since, null,
                case state when 'active' then 2 when 'disabled' then 3 else 4 end from checks
                where state <> 'active' or state_since > registered_at
            union all select check_id, 'redefined', recorded_at, version, 1 from versions where version >= 2)
         select check_id, kind, cast(e.at as varchar) as at, cast(coalesce(version, 0) as bigint) as version from every e
         order by e.at desc, step desc, check_id desc limit 100""",
)
def check_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = lifecycle.check_changes(derived(spark, sf, "checks"), versions_of(spark, sf), 100)
    return shown(changes.fillna(0, ["version"]))


@query(
    "retired_checks",
    with_tables("history", "checks", more=STATE)
    + f"""select c.check_id, c.name, c.dataset, h.outcome, cast(h.started_at as varchar) as started_at,
                 h.last_outcome from checks c left join heads h on h.check_id = c.check_id
          where c.state = 'retired' and not ({FOUND.replace('check_id', 'c.check_id')})""",
)
def retired_checks(spark: SparkSession, sf: str) -> DataFrame:
    from assay.operators.history import join_retired

    checks = derived(spark, sf, "checks")
    heads = state.current_heads(derived(spark, sf, "history"))
    gone = join_retired(checks, checks.where(FOUND), heads)
    return shown(gone, "check_id", "name", "dataset", "outcome", "started_at", "last_outcome")


# --- resumed runs -----------------------------------------------------------


@query(
    "datasets_to_scan",
    with_tables("results", "dataset_runs")
    + """select distinct r.run_id, r.datasource, r.dataset from results r left join dataset_runs d
           on d.run_id = r.run_id and d.datasource = r.datasource and d.dataset = r.dataset
           and d.outcome in ('pass', 'warn', 'fail', 'skipped') where d.run_id is null""",
)
def datasets_to_scan(spark: SparkSession, sf: str) -> DataFrame:
    selected = derived(spark, sf, "results")
    return resume.datasets_to_scan(selected, derived(spark, sf, "dataset_runs"))


@query(
    "unevaluated_checks",
    with_tables("results", "dataset_runs")
    + """select r.run_id, r.check_id from results r join dataset_runs d
           on d.run_id = r.run_id and d.datasource = r.datasource and d.dataset = r.dataset
         where d.outcome in ('pass', 'warn', 'fail', 'skipped') and r.result_id % 5 = 0""",
)
def unevaluated_checks(spark: SparkSession, sf: str) -> DataFrame:
    results = derived(spark, sf, "results")
    missed = resume.unevaluated_checks(
        results, derived(spark, sf, "dataset_runs"), results.where("result_id % 5 <> 0")
    )
    return missed.select("run_id", "check_id")


RETRIED = "result_id % 7 = 1"


@query(
    "replace_attempt",
    with_tables("results")
    + f""", retry as (select * from results where {RETRIED})
         select result_id, run_id, outcome from results r where not exists (select 1 from retry t
             where t.run_id = r.run_id and t.datasource = r.datasource and t.dataset = r.dataset)
         union all select -result_id, run_id, 'pass' from retry""",
)
def replace_attempt(spark: SparkSession, sf: str) -> DataFrame:
    results = derived(spark, sf, "results")
    retry = results.where(RETRIED).withColumns(
        {"result_id": -F.col("result_id"), "outcome": F.lit("pass")}
    )
    return resume.replace_attempt(results, retry).select("result_id", "run_id", "outcome")


# --- alerts -----------------------------------------------------------------

NOTIFY = """notified as (select check_id, unnest(case when check_id % 3 = 0 then ['chat', 'hook']
    when check_id % 3 = 1 then ['chat'] else [] end) as notifier from checks)"""


def checks_with_notifiers(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("check_id") % 3
    notify = (
        F.when(place == 0, F.array(F.lit("chat"), F.lit("hook")))
        .when(place == 1, F.array(F.lit("chat")))
        .otherwise(F.array().cast("array<string>"))
    )
    return derived(spark, sf, "checks").withColumn("notify", notify)


@query(
    "alerts_to_write",
    with_tables("history", "checks", "deliveries")
    + f", {STATE}"
    + f""", {NOTIFY}
       select s.run_id, s.check_id, n.notifier, s.event, s.previous_outcome from state s join notified n on n.check_id = s.check_id
       where s.event is not null
         and not exists (select 1 from history h where h.check_id = s.check_id and (h.started_at, h.run_id) > (s.started_at, s.run_id))
         and not exists (select 1 from deliveries d where d.run_id = s.run_id and d.check_id = s.check_id
                         and d.notifier = n.notifier and d.event = s.event)""",
)
def alerts_to_write(spark: SparkSession, sf: str) -> DataFrame:
    rows = history_rows(spark, sf, "check_id", "result_id", "run_id", "started_at", "outcome", "value", "run_key")
    changes = state.state_changes(rows.select("check_id", "result_id", "run_id", "started_at", "outcome"))
    deliveries = derived(spark, sf, "deliveries", {"history": rows})
    written = alerts.alerts_to_write(changes, checks_with_notifiers(spark, sf), deliveries, rows)
    return written.select("run_id", "check_id", "notifier", "event", "previous_outcome")


@query(
    "alerts_pending",
    with_tables("deliveries", "runs")
    + """, keyed as (select d.*, r.project, r.run_key, r.started_at, d.sent_at is not null as sent from deliveries d
             join runs r on r.run_id = d.run_id where r.run_key is not null),
         t as (select *, lag(event) over w as e, lag(sent) over w as s,
                 lead(run_id) over w is not null as later from keyed
               window w as (partition by project, run_key, check_id, notifier order by started_at, run_id))
       select delivery_id, later or coalesce(event = 'recovered' and e = 'failing' and not s, false) as superseded,
              attempts >= 5 or created_at < timestamp '1998-01-01' - interval 24 hour as expired
       from t where sent_at is null and abandoned_at is null""",
)
def alerts_pending(spark: SparkSession, sf: str) -> DataFrame:
    now = F.expr("timestamp_ntz '1998-01-01'")
    pending = alerts.alerts_pending(derived(spark, sf, "deliveries"), derived(spark, sf, "runs"), now)
    return pending.select("delivery_id", "superseded", "expired")


@query(
    "delivery_status",
    with_tables("deliveries")
    + """select notifier, case when sent_at is not null then 'sent' when abandoned_at is not null then 'abandoned'
                else 'pending' end as status, count(*) as n from deliveries group by 1, 2""",
)
def delivery_status(spark: SparkSession, sf: str) -> DataFrame:
    status = alerts.delivery_status().alias("status")
    return derived(spark, sf, "deliveries").groupBy("notifier", status).agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_alerts",
    with_tables("history", "checks", "deliveries", "runs", more=STATE)
    + """, told as (select run_id, check_id, event, string_agg(notifier || ' ' || case when sent_at is not null then 'sent'
              when abandoned_at is not null then 'abandoned' else 'pending' end, ',' order by notifier) as told
              from deliveries group by 1, 2, 3)
       select s.result_id, c.name, s.event, case when r.run_key is not null then coalesce(t.told, '') else '-' end as deliveries
       from state s join checks c on c.check_id = s.check_id join runs r on r.run_id = s.run_id
       left join told t on t.run_id = s.run_id and t.check_id = s.check_id and t.event = s.event where s.event is not null""",
)
def join_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = history_rows(spark, sf, "check_id", "result_id", "run_id", "started_at", "outcome", "value", "run_key")
    changes = state.state_changes(rows).select("result_id", "check_id", "run_id", "event")
    deliveries = derived(spark, sf, "deliveries", {"history": rows})
    joined = alerts.join_alerts(changes, derived(spark, sf, "checks"), derived(spark, sf, "runs"), deliveries)
    told = F.transform("deliveries", lambda d: F.concat_ws(" ", d["notifier"], d["status"]))
    deliveries = F.coalesce(F.array_join(told, ","), F.lit("-")).alias("deliveries")
    return joined.select("result_id", "name", "event", deliveries)


@query(
    "join_outbox",
    with_tables("deliveries", "runs", "checks", "results", "dataset_runs")
    + """select d.delivery_id, c.name, r.run_key, h.outcome as result_outcome, cast(s.finished_at as varchar) as recorded_at
         from deliveries d join runs r on r.run_id = d.run_id join checks c on c.check_id = d.check_id
         left join results h on h.run_id = d.run_id and h.check_id = d.check_id and h.result_id % 4 <> 0
         left join dataset_runs s on s.run_id = d.run_id and s.datasource = h.datasource and s.dataset = h.dataset""",
)
def join_outbox(spark: SparkSession, sf: str) -> DataFrame:
    joined = alerts.join_outbox(
        derived(spark, sf, "deliveries"),
        derived(spark, sf, "runs"),
        derived(spark, sf, "checks"),
        derived(spark, sf, "results").where("result_id % 4 <> 0"),
        derived(spark, sf, "dataset_runs"),
    )
    return shown(joined, "delivery_id", "name", "run_key", "result_outcome", "recorded_at")


@query(
    "notification_batches",
    with_tables("history", "checks", more=f"{STATE}, {NOTIFY}")
    + """select s.run_id, n.notifier, count(*) over (partition by s.run_id, n.notifier) as events, s.result_id, s.event
         from state s join notified n on n.check_id = s.check_id where s.event is not null""",
)
def notification_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = history_rows(spark, sf, "check_id", "result_id", "run_id", "started_at", "outcome")
    changes = state.state_changes(rows).drop("result_id")
    told = changes.join(checks_with_notifiers(spark, sf).select("check_id", "notify"), "check_id")
    told = told.withColumn("notifier", F.explode("notify"))
    batches = alerts.notification_batches(told, rows.select("run_id", "check_id", "result_id"))
    return batches.select("run_id", "notifier", "events", "result_id", "event")
