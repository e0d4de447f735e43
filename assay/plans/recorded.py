"""Queries over what is kept as runs are recorded: heads, intervals, samples, the log."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.outcomes import PROBLEM_ORDER
from assay.operators import history, record, rollups, samples, state, timeline
from assay.plans.fixtures import STATE, derived, shown, with_tables
from assay.plans.registry import query
from assay.sources.log import Log
from assay.sources.results import cut_lineage, settled, shared_folder

SHOWN = ("name", "dataset", "value")
# What comes as a batch: the newest results, and some late ones.
NEW = "started_at >= timestamp_ntz '2000-06-01' or result_id % 401 = 0"


def moved_on(spark: SparkSession, sf: str) -> tuple[DataFrame, timeline.Moved]:
    """Stored intervals of the history without the batch, and what the batch does to them."""
    rows = derived(spark, sf, "history")
    rows = cut_lineage(rows.select("check_id", "result_id", "run_id", "started_at", "outcome", *SHOWN))
    before = settled(timeline.replayed(rows.where(f"not ({NEW})"), carry=SHOWN))
    heads, closed = timeline.heads_of(before, SHOWN), timeline.closed_of(before)
    return closed, timeline.advance(heads, closed, rows.where(NEW), rows, SHOWN)


def logged(spark: SparkSession, sf: str) -> tuple[Log, DataFrame]:
    """A log with the heads and intervals after the batch, and the intervals read from it."""
    closed, moved = moved_on(spark, sf)
    log = Log(spark, shared_folder(spark))
    every = timeline.binned(timeline.still_closed(closed, moved.late).unionByName(moved.closed))
    log.commit(log.snapshot(), [log.write("closed", every)], [log.write("heads", moved.heads)])
    return log, record.intervals(log, log.snapshot())


@query(
    "overview_stored",
    with_tables("history", more=STATE)
    + """select h.check_id, h.result_id, h.outcome, cast(h.since as varchar) as since, r.name, r.dataset, r.value
         from heads h join history r on r.result_id = h.result_id and r.run_id = h.run_id""",
)
def overview_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The list of checks from the stored heads alone, moved on by a batch with late results."""
    log, _ = logged(spark, sf)
    return shown(record.overview(log), "check_id", "result_id", "outcome", "since", *SHOWN)


@query(
    "status_counts_stored",
    with_tables("history", more=STATE)
    + "select "
    + ", ".join(f"count(*) filter (where outcome = '{s}') as {s}" for s in PROBLEM_ORDER)
    + ", count(*) as total from heads",
)
def status_counts_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The counts above the list, from the same small table."""
    log, _ = logged(spark, sf)
    return rollups.status_counts(record.overview(log))


AS_OF = datetime(1998, 6, 1)


@query(
    "state_as_of_stored",
    with_tables("history")
    + ", cut as (select * from history where started_at < timestamp '1998-06-01' or (started_at = timestamp '1998-06-01' and run_id <= 'r0000005000')), "
    + STATE.replace("from history)", "from cut)")
    + """ select check_id, result_id, outcome, cast(since as varchar) as since, last_outcome, basis_alert from heads""",
)
def state_as_of_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The state as of an old run, looked up among stored intervals."""
    log, closed = logged(spark, sf)
    found = timeline.as_of(record.overview(log), closed, AS_OF, "r0000005000")
    return shown(found, "check_id", "result_id", "outcome", "since", "last_outcome", "basis_alert")


@query(
    "late_results",
    with_tables("history", more=STATE)
    + """, ended as (select check_id, result_id, o, event, lead(run_id) over w as until_run,
                lead(started_at) over w as until_at, case when is_eval then eval_since else raw_since end as since
             from state window w as (partition by check_id order by started_at, run_id))
         select check_id, result_id, o as outcome, cast(since as varchar) as since, until_run,
                cast(until_at as varchar) as until_at from ended where until_run is not null""",
)
def late_results(spark: SparkSession, sf: str) -> DataFrame:
    """All closed intervals after a batch with late results: replayed from each one's place on."""
    closed, moved = moved_on(spark, sf)
    every = timeline.still_closed(closed, moved.late).unionByName(moved.closed)
    return shown(every, "check_id", "result_id", "outcome", "since", "until_run", "until_at")


SAMPLES_AT = "timestamp_ntz '2000-09-05 13:00:00'"


@query(
    "baselines_stored",
    with_tables("clause_history")
    + """, old as (select *, row_number() over w as i, count(*) over (partition by clause_id) as n
             from clause_history where metric = 'sum' and measured is not null
               and started_at < timestamp '2000-09-05 13:00:00' and (run_key is null or run_key <> 'k7')
             window w as (partition by clause_id order by started_at desc, run_id desc)),
         days as (select *, row_number() over (partition by clause_id order by started_at desc, run_id desc) as j from old
             where started_at <= timestamp '2000-08-30' and dayofweek(started_at) = dayofweek(timestamp '2000-09-05'))
         select clause_id, 'previous run' as baseline, measured as previous, run_id as previous_run, 1::bigint as samples from old where i = 1
         union all select clause_id, 'same weekday', measured, run_id, 1 from days where j = 1
         union all select clause_id, 'last runs', round(sum(measured) / 7, 6), max(run_id) filter (i = 1), 7
             from old where i <= 7 and n >= 7 group by 1""",
)
def baselines_stored(spark: SparkSession, sf: str) -> DataFrame:
    """What a run compares with, from the stored samples, moved on by a batch with late results."""
    # Dealt by clause, so that tasks keep few rows of each.
    rows = settled(derived(spark, sf, "clause_history").repartition("clause_id"))
    late = "started_at >= timestamp_ntz '2000-06-01' or measured % 17 = 0"
    table = settled(samples.newest_samples(rows.where(f"not coalesce({late}, false)")))
    table = settled(samples.advance_samples(table, rows.where(late)))
    at = F.expr(SAMPLES_AT)
    clauses = rows.select("clause_id").distinct()
    parts = []
    for baseline, runs in (("previous run", 1), ("same weekday", 1), ("last runs", 7)):
        wanted = clauses.select(
            "clause_id", F.lit("sum").alias("metric"), F.lit(baseline).alias("baseline"), F.lit(runs).alias("runs")
        )
        found = samples.stored_baselines(table, wanted, at, "k7", rows)
        parts.append(found.withColumn("baseline", F.lit(baseline)))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return shown(found.withColumn("previous", F.round("previous", 6)), "clause_id", "baseline", "previous", "previous_run", "samples")


@query(
    "retry_recorded",
    with_tables("history")
    + """select project, cast(count(*) as bigint) as results, count(distinct run_id) as runs,
                cast(sum(case when dataset = 'db.t3' and result_id % 10 < 5 and value is not null then value + 1 else value end) as double) as total
         from history where not (dataset = 'db.t3' and result_id % 10 >= 5
              and run_id in (select run_id from history where dataset = 'db.t3' and result_id % 10 < 5)) group by 1""",
)
def retry_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Two commits, a write that stopped, and a retry of one dataset in its runs, read back."""
    log = Log(spark, shared_folder(spark))
    rows = derived(spark, sf, "history").select(
        "result_id", "run_id", "check_id", "datasource", "dataset", "outcome", "value", "project", "started_at"
    )
    rows = cut_lineage(rows)
    for half in ("month(started_at) <= 6", "month(started_at) > 6"):
        log.commit(log.snapshot(), [log.write("results", rows.where(half), ["project"])])
    log.write("results", rows, ["project"])  # stopped before its commit
    again = rows.where("dataset = 'db.t3' and result_id % 10 < 5").withColumn("value", F.col("value") + 1)
    base = log.snapshot()
    upto = F.lit(base.version).cast("long").alias("upto")
    hidden = again.select(*record.ATTEMPT, upto).distinct()
    log.commit(base, [log.write("results", again, ["project"]), log.write("replaced", hidden)])
    found = record.history(log, log.snapshot())
    return found.groupBy("project").agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("run_id").alias("runs"), F.sum("value").alias("total")
    )


@query(
    "pages_stored",
    with_tables("history", "runs", more=STATE)
    + """, r as (select 'runs' as page, run_id, null::bigint as result_id from runs
               where project = 'main' and exit_code is not null
                 and (started_at < timestamp '2000-01-01' or (started_at = timestamp '2000-01-01' and run_id < 'r0000007000'))
               order by started_at desc, run_id desc limit 50),
         h as (select 'check' as page, run_id, result_id from history where check_id = 3
               order by started_at desc, run_id desc limit 25),
         a as (select 'alerts' as page, run_id, result_id from state where event in ('failing', 'recovered')
                 and (started_at, run_id, result_id) < (timestamp '2000-01-01', 'r0000007000', 5)
               order by started_at desc, run_id desc, result_id desc limit 40)
         select * from r union all select * from h union all select * from a""",
)
def pages_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of runs, of one check's history and of alerts from tables stored by day, here by year."""
    folder = shared_folder(spark)

    def stored(name: str, rows: DataFrame) -> DataFrame:
        year = F.trunc(F.col("started_at").cast("date"), "year").alias("day")
        return cut_lineage_by_day(rows.select("*", year), f"{folder}/{name}")

    runs = stored("runs", derived(spark, sf, "runs"))
    rows = stored("history", derived(spark, sf, "history").select("check_id", "result_id", "run_id", "started_at", "outcome"))
    changes = stored("changes", state.state_changes(rows.drop("day")))
    before = [F.expr("timestamp_ntz '2000-01-01'"), F.lit("r0000007000")]
    newest = date(2000, 1, 1)
    wanted = changes.where(F.col("event").isin("failing", "recovered"))
    parts = [
        history.stored_page(history.finished(runs, "main"), history.RUN_ORDER, 50, newest, before),
        history.stored_page(rows.where("check_id = 3"), history.RUN_ORDER, 25, date(2001, 12, 31)),
        history.stored_page(wanted, (*history.RUN_ORDER, "result_id"), 40, newest, [*before, F.lit(5)]),
    ]
    pages = None
    for name, part in zip(("runs", "check", "alerts"), parts, strict=True):
        result_id = F.col("result_id") if "result_id" in part.columns else F.lit(None)
        part = part.select(F.lit(name).alias("page"), "run_id", result_id.cast("bigint").alias("result_id"))
        pages = part if pages is None else pages.unionByName(part)
    return pages


def cut_lineage_by_day(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.partitionBy("day").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
