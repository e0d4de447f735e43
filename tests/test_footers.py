"""Footer answers: equal to the scan's, read without one, and left to it where they would differ."""

from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from assay import Check, Clause, Rule, Suite
from assay.operators import footers
from assay.operators.measure import measure

NOW = datetime(2026, 1, 1)
ANY = Rule(">=", -100)
METRICS = ("missing_count", "min", "max")


def suite_of(*clauses, **options):
    return Suite("t", [Check("c", clauses)], **options)


def told(measured):
    return sorted(map(tuple, measured.collect()))


@pytest.fixture
def files(tmp_path):
    """Two files: whole numbers of all widths, unsigned ones, NaN, long text, NULLs; one column all NULL."""
    for i in range(2):
        size = 50
        many = np.arange(size) + 1000 * i
        nulls = many % 7 == 0
        columns = {
            "short": pa.array(many, pa.int16(), mask=nulls),
            "whole": pa.array(many * 1000, pa.int32()),
            "big": pa.array(many * 10**13, pa.int64(), mask=nulls),
            "unsigned": pa.array(many + 3_000_000_000, pa.uint32()),
            "real": pa.array(np.where(many % 5 == 0, np.nan, many), pa.float64()),
            "said": pa.array(["x" * 5000 + str(x) for x in many]),
            "none": pa.nulls(size, pa.int32()),
        }
        pq.write_table(pa.table(columns), tmp_path / f"{i}.parquet")
    return str(tmp_path)


def test_footers_tell_what_a_scan_does(spark, files):
    clauses = [Clause("row_count", expect=ANY)]
    for name in ("short", "whole", "big", "unsigned", "real", "none"):
        clauses += [Clause(m, (name,), ANY) for m in METRICS]
    clauses += [Clause("missing_count", ("said",), ANY), Clause("avg", ("whole",), ANY)]
    clauses += [Clause("min", ("said",), ANY), Clause("max", ("no_such",), ANY)]
    clauses.append(Clause("row_count", expect=ANY, where="whole > 5", name="scoped"))
    suite = suite_of(*clauses)
    want = told(measure(spark.read.parquet(files), suite, NOW))
    got = told(footers.measure_files(spark, files, suite, NOW))
    assert str(got) == str(want)


def test_no_data_is_read(spark, files):
    clauses = {
        "a": Clause("row_count", expect=ANY),
        "b": Clause("missing_count", ("said",), ANY),
        "c": Clause("max", ("whole",), ANY),
        "d": Clause("missing_count", ("real",), ANY),
    }
    df = footers.footer_totals(spark, files, clauses)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(said), MAX(whole), COUNT(real)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_what_footers_do_not_tell_is_scanned(spark, files, monkeypatch):
    asked = []
    do = footers.footer_totals
    monkeypatch.setattr(
        footers, "footer_totals", lambda s, p, clauses: (asked.append(sorted(c.metric for c in clauses.values())), do(s, p, clauses))[1]
    )
    row_count = Clause("row_count", expect=ANY)
    filtered = suite_of(row_count, filter="whole > 20000")
    assert told(footers.measure_files(spark, files, filtered, NOW))[0][1] == 79
    listed = Clause("missing_count", ("whole",), ANY, options={"missing_values": [0]})
    suite = suite_of(row_count, listed, Clause("max", ("real",), ANY), Clause("max", ("big",), ANY))
    found = {r.value for r in footers.measure_files(spark, files, suite, NOW).select("value").collect() if r.value == r.value}
    assert found >= {100.0, 1.0, float(1049 * 10**13)}
    assert asked == [["max", "row_count"]]


def test_files_without_statistics_and_empty_ones(spark, tmp_path):
    table = pa.table({"whole": pa.array([3, None, 4], pa.int32())})
    suite = suite_of(Clause("row_count", expect=ANY), *[Clause(m, ("whole",), ANY) for m in METRICS])
    pq.write_table(table, tmp_path / "plain.parquet", write_statistics=False)
    pq.write_table(table.slice(0, 0), tmp_path / "empty.parquet")
    for name, want in (("plain", [3, 1, 3, 4]), ("empty", [0, 0, None, None])):
        path = str(tmp_path / f"{name}.parquet")
        values = {r.clause_id: r.value for r in footers.measure_files(spark, path, suite, NOW).collect()}
        assert [values[i] for i, _, _ in suite.clause_ids()] == want
