"""What people are shown: values, changes, pages and facets."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from assay.functions.rows import literal_rows
from assay.operators import history, reports, search
from assay.operators.change import NO_BASELINES
from assay.operators.run import clause_results, run_suites
from assay.spec import Change, Check, Clause, Rule, Suite
from tests.test_state import final_plan

NOW = datetime(2024, 5, 10, 12, 0)


def changing():
    rule = Rule("between", "-20%", "20%")
    return Suite(
        "db.t",
        [
            Check("previous", [Clause("row_count", expect=rule, change=Change())]),
            Check("weekday", [Clause("row_count", expect=Rule(">", -1), change=Change("same weekday"))]),
            Check("average", [Clause("row_count", expect=Rule(">", 0), change=Change("last runs", 7))]),
            Check("plain", [Clause("row_count", expect=Rule(">", 0))]),
            Check("rows", [Clause("failed_rows", options={"condition": "id < 2"}, expect=Rule("<", 9))]),
            Check("both", [Clause("row_count", expect=Rule(">", 9)), Clause("missing_percent", ("id",), Rule("<", "1%"))]),
        ],
    )


def known(spark, suite):
    then, old = "2024-05-09 08:30:00", "2024-05-03 01:00:00"
    runs = {"previous": 1, "weekday": 1, "average": 7}
    ids = {check.name: clause_id for clause_id, check, _ in suite.clause_ids()}
    rows = [(ids[n], 4.0, then, "r7", k, old if k > 1 else then) for n, k in runs.items()]
    return literal_rows(spark, NO_BASELINES, rows)


def test_changes_tell_from_what_to_what_and_since_when(spark):
    suite = changing()
    found = clause_results(spark.range(5), suite, NOW, known(spark, suite)).collect()
    names = {suite.check_id(c): c.name for c in suite.checks}
    said = {names[r.check_id]: r for r in found if names[r.check_id] != "both"}
    assert said["previous"].message == "expected between -20% and 20%; 4 → 5 rows since the run of 2024-05-09 08:30 UTC"
    assert said["previous"].display_value == "+25.00%" and said["previous"].previous_run == "r7"
    assert said["weekday"].detail == "4 → 5 rows since the run of 2024-05-09 08:30 UTC (same weekday)"
    assert said["weekday"].display_value == "+1 row"
    assert said["average"].detail == "average 4 of the last 7 runs (2024-05-03 01:00 to 2024-05-09 08:30 UTC) → 5 rows"
    assert said["plain"].display_value == "5 rows" and said["plain"].previous is None
    assert said["rows"].display_value == "2 rows"
    shown = sorted(r.display_value for r in found if names[r.check_id] == "both")
    assert shown == ["0.00%", "5 rows"]


def test_a_run_keeps_display_values_and_reports_what_it_compared_with(spark):
    suite = changing()
    run = run_suites([(suite, spark.range(5))], NOW, project="p", run_id="r8", baselines=known(spark, suite))
    rows = {r["name"]: r for r in reports.report_rows(run.results, run.clauses).collect()}
    assert rows["plain"].display_value == "5 rows" and rows["both"].display_value == ""
    (clause,) = rows["average"].clauses
    assert clause.previous.asDict() == {
        "value": 4.0, "run_id": "r7", "started_at": datetime(2024, 5, 9, 8, 30), "baseline": "last runs", "runs": 7,
    }
    assert rows["plain"].clauses[0].previous is None


def test_a_page_of_a_stored_table_reads_its_newest_days(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"r{i:04d}", start + timedelta(hours=12 * i)) for i in range(400)]
    rows = spark.createDataFrame(rows, "run_id string, started_at timestamp").withColumn("day", F.to_date("started_at"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    for limit, newest, before in ((1, date(2024, 7, 18), None), (20, date(2024, 12, 31), None), (7, date(2024, 3, 1), [F.lit(datetime(2024, 3, 1, 5)).cast("timestamp"), F.lit("r")]), (999, date(2024, 2, 1), None)):
        page = history.stored_page(stored, history.RUN_ORDER, limit, newest, before)
        want = history.newest_page(rows.where(F.col("day") <= F.lit(newest)), history.RUN_ORDER, limit, before)
        assert [r.run_id for r in page.collect()] == [r.run_id for r in want.collect()]
    page = history.stored_page(stored, history.RUN_ORDER, 3, date(2024, 3, 1))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert page.select("day").distinct().count() == 2


def test_all_facets_are_counted_in_one_scan(spark, tmp_path):
    rows = [
        (i, f"check {i}", "a", "x", ["t", "u"][: i % 3] or None, f"Owner{i % 2}" if i % 4 else None, "fail" if i % 5 else None)
        for i in range(40)
    ]
    kinds = "check_id int, name string, dataset string, datasource string, tags array<string>, owner string, outcome string"
    made = spark.createDataFrame(rows, kinds).selectExpr("*", "name as expression", "name as path", "name as check_hash")
    made.write.parquet(str(tmp_path / "checks"))
    checks = spark.read.parquet(str(tmp_path / "checks"))
    query = {"needle": "check", "statuses": ["fail"], "chosen": {"tag": ["t"], "owner": ["Owner1", "Nobody"]}}
    found = search.all_facet_counts(checks, **query)
    want = {(f, r.value): r.checks for f in search.FACETS for r in search.facet_counts(checks, f, **query).collect()}
    assert {(r.facet, r.value): r.checks for r in found.collect()} == want
    assert final_plan(found).count("FileScan") == 1
