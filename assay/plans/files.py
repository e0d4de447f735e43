"""Queries of the file sources: the orders written in each format and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import state
from assay.operators.measure import measure
from assay.operators.history import read_history
from assay.operators.judge import rules_of
from assay.plans.fixtures import derived, history_rows, shown, table, with_tables
from assay.plans.measuring import NOW, clause, orders_suite, suite_of
from assay.plans.registry import query
from assay.operators.run import run_suites
from assay.sources import files, results, tables

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
KINDS = ("bigint", "bigint", "string", "double", "timestamp_ntz", "string")


def rows_sql(status: str = "o_orderstatus") -> str:
    return f"""select o_orderkey, o_custkey, {status} as o_orderstatus, o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders"""


ROWS = rows_sql()
BLANKS = rows_sql("nullif(o_orderstatus, 'P')")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*COLUMNS)


def as_orders(df: DataFrame) -> DataFrame:
    cells = [F.col(c).cast(k).alias(c) for c, k in zip(COLUMNS, KINDS, strict=True)]
    return shown(df.select(*cells))


@query("scan_table", ROWS)
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("assay_orders")
    return as_orders(tables.read_table(spark, "assay_orders"))


@query(
    "scan_csv",
    BLANKS,
)
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV with blanks where the status is P; half of it as TSV."""
    folder = results.shared_folder(spark)
    blank = orders(spark, sf).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    odd = F.col("o_orderkey") % 2 == 1
    blank.where(odd).write.csv(f"{folder}/comma", header=True)
    tabbed = blank.where(~odd).write.option("sep", "\t").option("header", True)
    # Spark's writer names files .csv whatever the separator.
    tabbed.option("emptyValue", "").csv(f"{folder}/tab")
    renamed(spark, f"{folder}/tab", ".csv", ".tsv")
    halves = [files.read_files(spark, folder, p) for p in ("comma/*.csv", "tab/*.tsv")]
    return files.union_by_name([as_orders(half) for half in halves])


def renamed(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give files of a folder another extension, through its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in files.expand(spark, folder, f"*{old}"):
        system.rename(path(name), path(name.removesuffix(old) + new))


@query("scan_parquet", ROWS)
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return as_orders(files.read_files(spark, sf, "orders.parquet"))


@query(
    "scan_json",
    BLANKS,
)
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    """One object per line; the status is an absent key where it is P."""
    folder = results.shared_folder(spark)
    absent = orders(spark, sf).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    absent.write.json(folder)
    return as_orders(files.read_files(spark, folder, "*.json"))


@query("scan_gz", ROWS)
def scan_gz(spark: SparkSession, sf: str) -> DataFrame:
    folder = results.shared_folder(spark)
    orders(spark, sf).write.option("compression", "gzip").csv(folder, header=True)
    return as_orders(files.read_files(spark, folder, "*.csv.gz"))


@query("scan_glob", ROWS)
def scan_glob(spark: SparkSession, sf: str) -> DataFrame:
    """Folders per status, read through `**`; a hidden folder is passed over."""
    folder = results.shared_folder(spark)
    rows = orders(spark, sf)
    rows.withColumn("part", F.col("o_orderstatus")).write.partitionBy("part").json(f"{folder}/all")
    rows.write.json(f"{folder}/.old")
    return as_orders(files.read_files(spark, folder, "**/part-*.json"))


@query(
    "union_by_name",
    rows_sql("case when o_orderkey % 3 <> 2 then o_orderstatus end"),
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files with other column orders, and a third of them without a column."""
    folder = results.shared_folder(spark)
    rows = orders(spark, sf)
    third = F.col("o_orderkey") % 3
    rows.where(third == 0).write.csv(f"{folder}/a", header=True)
    rows.where(third == 1).select(*reversed(COLUMNS)).write.csv(f"{folder}/b", header=True)
    rows.where(third == 2).drop("o_orderstatus").write.csv(f"{folder}/c", header=True)
    return as_orders(files.read_files(spark, folder, "[abc]/*.csv"))


@query(
    "write_results",
    with_tables("history")
    + """select project, cast(count(*) as bigint) as results, count(distinct run_id) as runs, cast(sum(value) as double) as total
         from history where exit_code is not null group by 1""",
)
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    """The history appended to result tables in two batches and read back."""
    folder = results.shared_folder(spark)
    keep = ["result_id", "run_id", "check_id", "outcome", "value", "project", "started_at"]
    history = history_rows(spark, sf, *keep).withColumn("month", F.month("started_at"))
    runs = derived(spark, sf, "runs").join(history.select("run_id").distinct(), "run_id", "left_semi")
    runs = results.settled(runs).withColumn("month", F.month("started_at"))
    for batch in ("month <= 6", "month > 6"):
        rows = history.where(batch).select(*keep).withColumn("year", F.year("started_at"))
        of_batch = runs.where(batch).drop("month").withColumn("year", F.year("started_at"))
        results.write_results(folder, of_batch, rows, rows, by="year")
    stored = results.read_results(spark, folder, "results").drop("year")
    runs_back = results.read_results(spark, folder, "runs")
    return read_history(stored, runs_back).groupBy("project").agg(
        F.count(F.lit(1)).alias("results"),
        F.countDistinct("run_id").alias("runs"),
        F.sum("value").alias("total"),
    )


@query(
    "scan_suite",
    """select 'avg(o_totalprice)' as clause, round(avg(o_totalprice), 4) as value from orders
       union all select 'duplicate_count(o_orderkey)', count(*) - count(distinct o_orderkey) from orders
       union all select 'missing_count(o_orderstatus)', count(*) filter (where o_orderstatus = 'P') from orders
       union all select 'row_count', count(*) from orders""",
)
def scan_suite(spark: SparkSession, sf: str) -> DataFrame:
    """A suite over a file dataset gives what it gives over the table."""
    folder = results.shared_folder(spark)
    blank = orders(spark, sf).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    blank.write.csv(folder, header=True)
    suite = suite_of(
        clause("row_count"),
        clause("missing_count", "o_orderstatus"),
        clause("avg", "o_totalprice"),
        clause("duplicate_count", "o_orderkey"),
    )
    measured = measure(files.read_files(spark, folder, "*.csv"), suite, NOW)
    rules = rules_of(spark, suite).select("clause_id", F.col("clause_key").alias("clause"))
    return rules.join(measured, "clause_id").select("clause", F.round("value", 4).alias("value"))


@query(
    "run_recorded",
    """select 'main' as project, 5 as total, case when max(o_totalprice) >= 400000 then 'fail' else 'warn' end as outcome
       from orders""",
)
def run_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run: suite measured, judged, recorded, and read back from its table."""
    folder = results.shared_folder(spark)
    run = run_suites(
        [(orders_suite(), table(spark, sf, "orders"))], NOW, project="main", run_id="r1"
    )
    results.write_results(folder, run.runs, run.results, run.clauses)
    back = results.read_results(spark, folder, "runs")
    return shown(back, "project", "total", "outcome").withColumn("total", F.col("total").cast("int"))


@query(
    "state_recorded",
    """select 'keys are unique' as name, 'r1' as run_id, 'failing' as event from orders having count(*) > 0
       union all select 'keys are unique', 'r2', 'recovered' from orders having count(*) > 0
       union all select 'prices are plausible', 'r1', 'failing' from orders having max(o_totalprice) >= 400000""",
)
def state_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Two recorded runs, every order twice in the first, read back and compared."""
    folder = results.shared_folder(spark)
    given = table(spark, sf, "orders")
    for day, (run_id, rows) in enumerate({"r1": given.unionAll(given), "r2": given}.items()):
        now = NOW + timedelta(days=day)
        run = run_suites([(orders_suite(), rows)], now, project="main", run_id=run_id)
        results.write_results(folder, run.runs, run.results, run.clauses)
    stored = results.read_results(spark, folder, "results")
    history = read_history(stored, results.read_results(spark, folder, "runs"), "main")
    changes = state.state_changes(history.select("check_id", "result_id", "run_id", "started_at", "outcome"))
    names = stored.select("check_id", "name").distinct()
    return changes.join(names, "check_id").select("name", "run_id", "event")
