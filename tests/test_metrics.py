"""Every metric on five rows whose values are known by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay import Check, Clause, Rule, Suite
from assay.operators.judge import fold_checks, judge, rules_of
from assay.operators.measure import CONVERSION, measure, measure_isolated
from assay.operators.metrics import Metric, register_metric

NOW = datetime(2026, 1, 1, 12)
HOUR = timedelta(hours=1)
ANY = Rule(">=", -100)


@pytest.fixture(scope="module")
def t(spark):
    rows = [
        (1, "a", "ok", 10.0, "x@y.io", NOW - HOUR),
        (2, "a", "ok", 20.0, None, NOW - 2 * HOUR),
        (3, "b", "bad", 30.0, "", NOW - 3 * HOUR),
        (3, "b", "ok", None, "z@y.io", NOW - 4 * HOUR),
        (5, "b", None, -40.0, "q@y.io", NOW - 5 * HOUR),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, grp string, status string, amount double, email string, ts timestamp_ntz",
    )
    df.createOrReplaceTempView("five")
    return df


CASES = [
    (5, "row_count", (), {}),
    (1, "missing_count", ("email",), {}),
    (2, "missing_count", ("email",), {"missing_values": [""]}),
    (1, "missing_count", ("email",), {"missing_values": [None]}),
    (20, "missing_percent", ("email",), {}),
    (2, "distinct_count", ("grp",), {}),
    (1, "duplicate_count", ("id",), {}),
    (1, "duplicate_count", ("id", "grp"), {}),
    (20, "duplicate_percent", ("id",), {}),
    (1, "duplicate_count", ("status", "grp"), {}),
    (-40, "min", ("amount",), {}),
    (30, "max", ("amount",), {}),
    (5, "avg", ("amount",), {}),
    (20, "sum", ("amount",), {}),
    (14, "sum", ("id",), {}),
    (3600, "freshness", ("ts",), {}),
    (1, "invalid_count", ("status",), {"valid_values": ["ok"]}),
    (4, "invalid_count", ("status",), {"valid_values": [None]}),
    (1, "invalid_count", ("status",), {"valid_length": 2}),
    (3, "invalid_count", ("status",), {"valid_min_length": 3}),
    (1, "invalid_count", ("status",), {"valid_max_length": 2}),
    (1, "invalid_count", ("status",), {"valid_regex": "^o"}),
    (1, "invalid_count", ("amount",), {"valid_min": 0}),
    (0, "invalid_count", ("status",), {"valid_values": ["ok"], "missing_values": ["bad"]}),
    (20, "invalid_percent", ("status",), {"valid_values": ["ok"]}),
    (1, "failed_rows", (), {"condition": "amount < 0"}),
    (2, "sql_metric", (), {"query": "select count(*) from five where amount > 15"}),
    (
        2,
        "schema",
        (),
        {
            "required_columns": ["id", "nope"],
            "forbidden_columns": ["email"],
            "column_types": {"id": "INTEGER"},
        },
    ),
]


def measured(df, *clauses, **options):
    suite = Suite("t", [Check("c", clauses)], **options)
    rules = rules_of(df.sparkSession, suite).select("clause_id", "clause_key")
    rows = rules.join(measure(df, suite, NOW), "clause_id").collect()
    return {row.clause_key: row for row in rows}


def test_values(t):
    clauses = [
        Clause(metric, args, ANY, options=options, name=str(i))
        for i, (_, metric, args, options) in enumerate(CASES)
    ]
    found = measured(t, *clauses)
    for i, (wanted, *case) in enumerate(CASES):
        assert found[str(i)].value == wanted, case
        assert found[str(i)].error is None, case


def test_where_and_filter(t):
    clause = Clause("row_count", expect=ANY, where="grp = 'a' -- the first group")
    assert measured(t, clause)["row_count"].value == 2
    twice = Clause("duplicate_count", ("id",), ANY)
    assert measured(t, twice, filter="grp = 'a'")["duplicate_count(id)"].value == 0
    # A user's own query is run as written, without the filter.
    query = Clause("sql_metric", expect=ANY, options={"query": "select count(*) from five"})
    assert measured(t, query, filter="grp = 'a'")["sql_metric"].value == 5


def test_nothing_in_scope(t):
    clauses = [
        Clause("missing_percent", ("email",), Rule("=", 0), where="1 = 0"),
        Clause("duplicate_percent", ("id",), Rule("=", 0), where="1 = 0"),
        Clause("avg", ("amount",), ANY, where="1 = 0"),
        Clause("freshness", ("ts",), ANY, where="1 = 0"),
    ]
    suite = Suite("t", [Check(str(i), [c]) for i, c in enumerate(clauses)])
    judged = judge(measure(t, suite, NOW), rules_of(t.sparkSession, suite))
    rows = {r.clause_key: r for r in judged.collect()}
    for share in ("missing_percent(email)", "duplicate_percent(id)"):
        assert (rows[share].value, rows[share].outcome) == (0, "pass")
        assert rows[share].detail == "no rows in scope"
    for none in ("avg(amount)", "freshness(ts)"):
        assert (rows[none].value, rows[none].outcome) == (None, "fail")


def test_freshness_in_other_zones_and_types(spark):
    df = spark.sql(
        """select timestamp_ntz '2026-01-01 10:00:00' as wall, timestamp '2026-01-01 10:00:00Z' as instant,
                  date '2026-01-01' as day, '2026-01-01T11:30:00.250+01:00' as zoned, '2025-12-31' as text,
                  'soon' as words, timestamp_ntz '2026-01-01 12:00:30' as ahead"""
    )
    names = ("wall", "instant", "day", "zoned", "text", "words", "ahead")
    clauses = [Clause("freshness", (n,), ANY, name=n) for n in names]
    found = {k: r.value for k, r in measured(df, *clauses, zone="Europe/Berlin").items()}
    assert found == {
        "wall": 10800,
        "instant": 7200,
        "day": 46800,
        "zoned": 5399.75,
        "text": 46800 + 86400,
        "words": None,
        "ahead": 3570,
    }
    assert measured(df, clauses[-1])["ahead"].value == -30
    words = measured(df, clauses[5])["words"].error
    assert words.endswith("got other text") and "soon" not in words


def test_freshness_does_not_depend_on_the_session_zone(spark, t):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert measured(t, Clause("freshness", ("ts",), ANY))["freshness(ts)"].value == 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_wrong_inputs_are_errors_without_values(t):
    found = measured(
        t,
        Clause("avg", ("email",), ANY),
        Clause("max", ("ts",), ANY),
        Clause("freshness", ("amount",), ANY),
        Clause("missing_count", ("email",), ANY, options={"missing_values": [7]}),
        Clause("missing_count", ("gone",), ANY),
        Clause("sql_metric", expect=ANY, options={"query": "select email from five"}),
        Clause("row_count", expect=ANY),
    )
    assert found["row_count"].value == 5
    errors = {key: row.error for key, row in found.items() if key != "row_count"}
    assert errors["avg(email)"] == "avg needs a numeric column; got text"
    assert errors["max(ts)"] == "max needs a numeric column; got timestamp"
    assert "got numeric" in errors["freshness(amount)"]
    assert "holds numbers but the column holds text" in errors["missing_count(email)"]
    assert "gone" in errors["missing_count(gone)"]
    assert "must return a number; got text" in errors["sql_metric"]
    assert not any("@" in text for text in errors.values())


def test_a_list_with_text_is_compared_as_text(t):
    clause = Clause("missing_count", ("id",), ANY, options={"missing_values": ["", "N/A", 3]})
    assert measured(t, clause)["missing_count(id)"].value == 2


def test_one_failing_measure_does_not_spoil_the_others(t):
    suite = Suite(
        "t",
        [
            Check(
                "c",
                [
                    Clause("row_count", expect=ANY),
                    Clause("failed_rows", options={"condition": "cast(email as int) > 1"}),
                ],
            )
        ],
    )
    rows = measure_isolated(t, suite, NOW).collect()
    ids = {clause.key: i for i, _, clause in suite.clause_ids()}
    found = {row.clause_id: row for row in rows}
    assert found[ids["row_count"]].value == 5
    assert found[ids["failed_rows"]].error == CONVERSION


def test_big_whole_numbers_are_added_exactly(spark):
    df = spark.range(4).select(F.lit(2**62).alias("n"))
    assert measured(df, Clause("sum", ("n",), ANY))["sum(n)"].value == float(2**64)


def test_a_metric_of_ones_own(t):
    register_metric(
        Metric(
            "negative_count",
            "count",
            least_args=1,
            most_args=1,
            measure=lambda ctx: (ctx.count_where(ctx.column < 0), None),
        )
    )
    found = measured(t, Clause("negative_count", ("amount",), ANY))
    assert found["negative_count(amount)"].value == 1
    with pytest.raises(ValueError):
        register_metric(Metric("row_count", "count", how="keys"))


def test_specs_refuse_what_cannot_be_measured():
    for broken in (
        lambda: Clause("no_such_metric", expect=ANY),
        lambda: Clause("avg", expect=ANY),
        lambda: Clause("row_count"),
        lambda: Clause("row_count", expect=ANY, warn=ANY),
        lambda: Clause("invalid_count", ("a",), ANY),
        lambda: Clause("row_count", expect=ANY, options={"valid_min": 1}),
        lambda: Clause("schema", where="a > 1", options={"required_columns": ["a"]}),
        lambda: Rule("between", 1),
        lambda: Rule("~", 1),
        lambda: Check("c", [Clause("row_count", expect=ANY)] * 2),
        lambda: Suite("t", [Check("c", [Clause("row_count", expect=ANY)])] * 2),
    ):
        with pytest.raises(ValueError):
            broken()


def test_a_fused_scan_reads_once_and_copies_no_row(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    clauses = [
        Clause("row_count", expect=ANY),
        Clause("missing_percent", ("l_tax",), ANY),
        Clause("avg", ("l_quantity",), ANY, where="l_returnflag = 'R'"),
        Clause("max", ("l_quantity",), ANY),
        Clause("failed_rows", options={"condition": "l_tax > 1"}),
    ]
    suite = Suite("t", [Check("c", clauses)], filter="l_discount < 0.05")
    plan = measure(lines, suite, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan
    assert "LessThan(l_discount,0.05)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string>" in plan


def test_checks_fold_their_clauses(t):
    suite = Suite(
        "t",
        [
            Check("one", [Clause("row_count", expect=Rule("<", 5))]),
            Check(
                "two",
                [
                    Clause("row_count", warn=Rule(">", 4), fail=Rule(">", 9), name="rows"),
                    Clause("avg", ("email",), ANY),
                    Clause("max", ("amount",), Rule("between", 0, 50)),
                ],
            ),
        ],
    )
    folded = fold_checks(judge(measure(t, suite, NOW), rules_of(t.sparkSession, suite)))
    rows = {row.check_id: row for row in folded.collect()}
    one, two = (rows[suite.check_id(check)] for check in suite.checks)
    assert (one.outcome, one.value, one.message) == ("fail", 5, "expected < 5")
    assert (two.outcome, two.value) == ("error", None)
    assert two.message == (
        "rows: warn when > 4; avg(email): avg needs a numeric column; got text"
    )


def test_values_are_rounded_as_binary_numbers_and_signed(spark):
    from assay.functions.text import format_value

    percents = [0.125, 0.375, 1.115, 2.675, 1.005, 0.145, -0.125, 99.995, 1e15, 0.0, 5e-324, 0.004999, 123456.785]
    numbers = [1e6, 1e-5, 123456.7, 1234567.0, 0.1, -2.5, 100.0, 1e100, 3.0]
    rows = [("percent", v, f"{v:.2f}%") for v in percents] + [("number", v, f"{v:.6g}") for v in numbers]
    df = spark.createDataFrame(rows, "unit string, value double, want string")
    got = df.select("want", format_value(F.col("unit"), F.col("value")).alias("shown")).collect()
    assert [r.shown for r in got] == [r.want for r in got]
    signed = format_value(F.col("unit"), F.col("value"), signed=True)
    rises = {r[0]: r[1] for r in df.select("value", signed).collect()}
    assert rises[0.375] == "+0.38%" and rises[-0.125] == "-0.12%"
    assert rises[0.004999] == "0.00%" and rises[1e6] == "+1e+06"


def test_one_grouping_serves_every_scope_of_its_keys(spark, tmp_path):
    rows = [(i % 5 if i % 7 else None, i) for i in range(50)]
    spark.createDataFrame(rows, "k int, v int").write.parquet(str(tmp_path / "t"))
    scopes = [None, "v < 20", "v > 45"]
    clauses = [
        Clause(m, ("k",), Rule(">=", 0), where=w, name=f"{m} {w}")
        for m in ("distinct_count", "duplicate_count")
        for w in scopes
    ]
    suite = Suite("d", [Check("c", clauses)])
    df = measure(spark.read.parquet(str(tmp_path / "t")), suite, datetime(2026, 1, 1))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    keys = {c: i for i, _, c in ((i, k, c.key) for i, k, c in suite.clause_ids())}
    got = {r.clause_id: r.value for r in df.collect()}
    for scope, test in zip(scopes, (lambda v: True, lambda v: v < 20, lambda v: v > 45), strict=True):
        held = [k for k, v in rows if k is not None and test(v)]
        assert got[keys[f"distinct_count {scope}"]] == len(set(held))
        assert got[keys[f"duplicate_count {scope}"]] == len(held) - len(set(held))
