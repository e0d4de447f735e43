"""File datasets and result tables, over files written for each test."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay import Change, Check, Clause, Rule, Suite
from assay.operators import state
from assay.operators.change import baselines_for
from assay.operators.history import history_page, read_history
from assay.operators.run import run_suites
from assay.sources import files, results

NOW = datetime(2026, 1, 1)


def rows_of(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_csv_files_are_matched_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name,amount\n1,x,5\n2,"",\n')
    (tmp_path / "b.csv").write_text("amount,id,name\n7.5,3,z\n")
    (tmp_path / "c.csv").write_text("id,amount\n4,9\n")
    (tmp_path / ".old.csv").write_text("id,name,amount\n9,hidden,1\n")
    df = files.read_files(spark, str(tmp_path), "*.csv")
    assert dict(df.dtypes) == {"id": "int", "name": "string", "amount": "double"}
    assert sorted(df.columns) == ["amount", "id", "name"]
    found = {r.id: (r.name, r.amount) for r in df.collect()}
    assert found == {1: ("x", 5), 2: (None, None), 3: ("z", 7.5), 4: (None, 9)}


def test_text_beats_numbers_where_files_disagree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,code\n1,5\n")
    (tmp_path / "b.csv").write_text("code,id\nx9,2\n")
    df = files.read_files(spark, str(tmp_path), "[ab].csv")
    assert rows_of(df, "id", "code") == [(1, "5"), (2, "x9")]


def test_every_format_reads_the_same(spark, tmp_path):
    data = [{"id": i, "name": f"n{i}"} for i in range(5)]
    text = "id,name\n" + "".join(f"{d['id']},{d['name']}\n" for d in data)
    (tmp_path / "t.csv").write_text(text)
    (tmp_path / "t.tsv").write_text(text.replace(",", "\t"))
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "t.json").write_text(json.dumps(data, indent=2))
    for name in ("t.jsonl", "t.ndjson", "lines.json"):
        (tmp_path / name).write_text("\n".join(map(json.dumps, data)))
    (tmp_path / "t.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, data)).encode()))
    spark.createDataFrame(data).coalesce(1).write.parquet(str(tmp_path / "p"))
    names = "t.csv t.tsv t.csv.gz t.json t.jsonl t.ndjson lines.json t.jsonl.gz p/*.parquet".split()
    for name in names:
        df = files.read_files(spark, str(tmp_path), name)
        assert rows_of(df, "id", "name") == [(i, f"n{i}") for i in range(5)], name


def test_patterns(spark, tmp_path):
    for path in ("2024/01/a.csv", "2024/02/b.csv", "2025/c.csv", "d.csv", "e 1/é.csv", ".x/e.csv", "2024/.y/f.csv"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"f\n{path}\n")

    def found(pattern):
        df = files.read_files(spark, str(tmp_path), pattern)
        return [r[0] for r in rows_of(df, "f")]

    assert found("*.csv") == ["d.csv"]
    assert found("**/*.csv") == ["2024/01/a.csv", "2024/02/b.csv", "2025/c.csv", "d.csv", "e 1/é.csv"]
    assert found("2024/*/[ab].csv") == ["2024/01/a.csv", "2024/02/b.csv"]
    assert found("2024/0?/**/*.csv") == ["2024/01/a.csv", "2024/02/b.csv"]
    assert found("20*/c.csv") == ["2025/c.csv"]
    assert found(".x/*.csv") == [".x/e.csv"]
    with pytest.raises(files.NoSuchFiles):
        files.read_files(spark, str(tmp_path), "**/*.csv", most_files=3)
    for pattern in ("*.tsv", "nowhere/*.csv"):
        with pytest.raises(files.NoSuchFiles):
            found(pattern)
    with pytest.raises(ValueError):
        files.format_of("a.xlsx")


def test_files_that_spark_would_pass_over_are_refused_by_name(spark, tmp_path):
    for name in ("x.csv", "_y.csv"):
        (tmp_path / name).write_text("f\n1\n")
    for pattern in ("*.csv", "_y.csv", "**/*.csv"):
        with pytest.raises(files.NoSuchFiles, match="_y.csv"):
            files.read_files(spark, str(tmp_path), pattern)
    assert files.read_files(spark, str(tmp_path), "[!_]*.csv").count() == 1


def test_folders_may_go_as_deep_as_they_like(spark, tmp_path):
    deep = tmp_path.joinpath(*["d"] * 40)
    deep.mkdir(parents=True)
    (deep / "a.csv").write_text("f\n1\n")
    assert files.read_files(spark, str(tmp_path), "**/*.csv").count() == 1


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_without_an_offset_are_wall_times_in_any_session(spark, tmp_path, zone):
    (tmp_path / "a.csv").write_text("id,at,day\n1,2025-12-31 12:00:00,2025-12-30\n")
    (tmp_path / "b.csv").write_text("at,id,day\n2025-12-31T06:00:00,2,2025-12-30\n")
    suite = Suite("d", [Check("c", [Clause("freshness", ("at",), Rule("<", "2d"))])])
    ages = []
    for name in ("UTC", "America/New_York", "Asia/Tokyo"):
        zone(name)
        df = files.read_files(spark, str(tmp_path), "*.csv")
        assert dict(df.dtypes) == {"id": "int", "at": "timestamp_ntz", "day": "date"}
        run = run_suites([(suite, df)], NOW, project="p", run_id="r")
        ages.append(run.results.first().value)
    assert ages == [43_200] * 3


def test_instants_beside_wall_times_stay_as_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at\n1,2025-12-31 12:00:00\n")
    (tmp_path / "b.csv").write_text("at,id\n2025-12-31T12:00:00Z,2\n")
    df = files.read_files(spark, str(tmp_path), "*.csv")
    assert rows_of(df, "id", "at") == [(1, "2025-12-31 12:00:00"), (2, "2025-12-31T12:00:00Z")]


def test_json_arrays_and_lines_agree_on_types(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "n": 2}, {"id": 3}], indent=1))
    (tmp_path / "b.json").write_text('{"id": "x9", "n": 2.5}\n{"id": "y", "m": true}\n')
    df = files.read_files(spark, str(tmp_path), "*.json")
    assert rows_of(df.where("n is not null"), "id", "n") == [("1", 2.0), ("x9", 2.5)]
    assert df.count() == 4 and dict(df.dtypes)["m"] == "boolean"


def test_a_given_schema_is_used(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n1,2\n")
    schema = T.StructType().add("id", "string").add("amount", "decimal(10,2)")
    df = files.read_files(spark, str(tmp_path), "*.csv", schema)
    assert dict(df.dtypes) == {"id": "string", "amount": "decimal(10,2)"}


def suite():
    return Suite(
        "sales.orders",
        [
            Check("rows", [Clause("row_count", expect=Rule(">", 2))], notify=("chat",)),
            Check(
                "steady",
                [Clause("sum", ("n",), Rule("between", "-10%", "10%"), change=Change())],
            ),
            Check("off", [Clause("row_count", expect=Rule("<", 0))], enabled=False),
        ],
        owner="me",
        tags=("daily",),
    )


def test_runs_are_recorded_and_compared_with(spark, tmp_path):
    root, later = str(tmp_path), datetime(2026, 1, 2)
    df = spark.range(1, 5).withColumnRenamed("id", "n")
    first = run_suites([(suite(), df)], NOW, project="p", run_id="r1")
    results.write_results(root, first.runs, first.results, first.clauses)
    stored = {r.name: r for r in results.read_results(spark, root, "results").collect()}
    assert set(stored) == {"rows", "steady"}
    assert (stored["rows"].outcome, stored["rows"].value, stored["rows"].owner) == ("pass", 4, "me")
    assert stored["steady"].outcome == "skipped"
    assert stored["steady"].message == "no earlier result to compare with"
    clauses = results.read_results(spark, root, "clauses")
    history = clauses.withColumn("run_key", F.lit(None).cast("string"))
    before = baselines_for(history, [suite()], F.lit(later).cast("timestamp"))
    assert [r.previous for r in before.collect()] == [10]
    too_early = baselines_for(history, [suite()], F.lit(NOW).cast("timestamp"))
    assert too_early.isEmpty()
    more = spark.range(1, 7).withColumnRenamed("id", "n")
    second = run_suites([(suite(), more)], later, project="p", run_id="r2", baselines=before)
    found = {r.name: r for r in second.results.collect()}
    assert (found["steady"].outcome, round(found["steady"].value, 6)) == ("fail", 110)
    run = second.runs.first()
    assert (run.outcome, run.exit_code, run.total, run.failed) == ("fail", 1, 2, 1)
    results.write_results(root, second.runs, second.results, second.clauses)
    runs = results.read_results(spark, root, "runs")
    stored = results.read_results(spark, root, "results")
    history = read_history(stored, runs, "p")
    assert history.count() == 4
    assert "PartitionFilters: [isnotnull(project" in history._jdf.queryExecution().toString()
    assert read_history(stored, runs, "q").count() == 0
    unfinished = runs.withColumn("exit_code", F.lit(None).cast("int"))
    assert read_history(stored, unfinished, "p").count() == 0


def test_recorded_runs_can_be_analysed(spark, tmp_path):
    root = str(tmp_path)
    for day, rows in enumerate((2, 5, 5, 1)):
        df = spark.range(rows).withColumnRenamed("id", "n")
        now = datetime(2026, 1, 1 + day)
        run = run_suites([(suite(), df)], now, project="p", run_id=f"r{day}", isolate=day % 2 == 0)
        results.write_results(root, run.runs, run.results, run.clauses)
    stored, runs = (results.read_results(spark, root, t) for t in ("results", "runs"))
    history = read_history(stored, runs, "p")
    assert history.select("result_id").distinct().count() == history.count() == 8
    assert {r.metric for r in stored.select("metric").distinct().collect()} == {"row_count", "sum"}
    rows_check = stored.where("name = 'rows'").first().check_id
    events = state.state_changes(history).where(F.col("check_id") == rows_check).orderBy("started_at")
    assert [(r.run_id, r.event) for r in events.collect()] == [("r0", "failing"), ("r1", "recovered"), ("r3", "failing")]
    heads = {r.check_id: r for r in state.current_heads(history).collect()}
    assert heads[rows_check].outcome == "fail" and len(heads) == 2
    page = history_page(history, rows_check, 2).collect()
    assert [r.run_id for r in page] == ["r3", "r2"]


def test_a_retried_dataset_replaces_its_rows_alone(spark, tmp_path):
    schema = "run_id string, datasource string, dataset string, check_id int, outcome string, project string, started_at timestamp"
    one, two = NOW, datetime(2026, 1, 2)
    rows = [
        ("r1", "ds", "a", 1, "error", "p", one),
        ("r1", "ds", "b", 2, "pass", "p", one),
        ("r2", "ds", "a", 1, "pass", "p", one),
        ("r3", "ds", "a", 1, "error", "p", two),
    ]
    stored = results.with_day(spark.createDataFrame(rows, schema))
    stored.write.partitionBy("project", "day").parquet(f"{tmp_path}/results")
    untouched = set((tmp_path / "results" / "project=p" / "day=2026-01-02").iterdir())
    results.replace_dataset(str(tmp_path), spark.createDataFrame([("r1", "ds", "a", 3, "fail", "p", one)], schema))
    back = results.read_results(spark, str(tmp_path), "results")
    assert rows_of(back, "run_id", "dataset", "check_id", "outcome") == [
        ("r1", "a", 3, "fail"), ("r1", "b", 2, "pass"), ("r2", "a", 1, "pass"), ("r3", "a", 1, "error"),
    ]
    assert set((tmp_path / "results" / "project=p" / "day=2026-01-02").iterdir()) == untouched


def test_the_shared_folder_is_the_clusters(spark):
    assert results.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
