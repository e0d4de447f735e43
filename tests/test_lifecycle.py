"""Registry syncs, definitions, alerts and judging at their edges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay import Rule
from assay.functions import text
from assay.operators import alerts, judge, lifecycle, rollups, search
from assay.spec import Check, Clause, Suite, short_hash

START = datetime(2024, 1, 1)


def later():
    return F.lit(START + timedelta(days=9)).cast("timestamp")


def registry(spark, *rows):
    full = [(i, f"n{i}", "d", "s", state, START) for i, state in rows]
    return spark.createDataFrame(
        full, "check_id int, name string, dataset string, datasource string, state string, state_since timestamp"
    )


def loaded(spark, *rows):
    full = [(i, f"n{i}", "d", "s", enabled) for i, enabled in rows]
    return spark.createDataFrame(
        full, "check_id int, name string, dataset string, datasource string, enabled boolean"
    )


def test_a_sync_tells_what_it_changed(spark):
    have = registry(
        spark, (1, "active"), (2, "active"), (3, "retired"), (4, "disabled"), (5, "active"), (6, "retired")
    )
    want = loaded(spark, (1, True), (2, False), (3, False), (4, True), (7, False))
    rows = {r.check_id: r for r in lifecycle.registry_sync(have, want, later()).collect()}
    assert {i: (r.state, r.changed) for i, r in rows.items()} == {
        1: ("active", None),
        2: ("disabled", "disabled"),
        3: ("disabled", "returned"),
        4: ("active", "enabled"),
        5: ("retired", "retired"),
        6: ("retired", None),
        7: ("disabled", "added"),
    }
    assert rows[1].state_since == rows[6].state_since == START
    assert rows[2].state_since == START + timedelta(days=9)


def test_a_sync_without_checks_is_refused(spark):
    none = loaded(spark)
    with pytest.raises(lifecycle.NothingToSync):
        lifecycle.refuse_empty(registry(spark, (1, "active")), none)
    lifecycle.refuse_empty(registry(spark, (1, "retired")), none)
    lifecycle.refuse_empty(registry(spark, (1, "active")), loaded(spark, (1, True)))


def definition(*clauses):
    return [
        {"key": k, "expression": e, "where": w, "options": o, "sql_options": ["condition"]}
        for k, e, w, o in clauses
    ]


def fingerprints(spark, *definitions):
    rows = [(i, d) for i, d in enumerate(definitions)]
    df = spark.createDataFrame(rows, f"check_id int, clauses {lifecycle.CLAUSES}")
    prints = df.select("check_id", lifecycle.definition_fingerprint(F.col("clauses")).alias("f"))
    return [r.f for r in prints.orderBy("check_id").collect()]


def test_what_makes_a_new_definition(spark):
    a = ("a", "failed_rows = 0", "x  > 1", {"condition": "n <  0", "valid_regex": "a  b"})
    b = ("b", "row_count > 0", None, {})
    spaced = ("a", "failed_rows = 0", " x > 1\n", {"valid_regex": "a  b", "condition": "n < 0"})
    looser = ("a", "failed_rows = 0", "x > 1", {"condition": "n < 1", "valid_regex": "a  b"})
    regex = ("a", "failed_rows = 0", "x > 1", {"condition": "n < 0", "valid_regex": "a b"})
    base, same, *others = fingerprints(
        spark, definition(a, b), definition(b, spaced), definition(looser, b),
        definition(regex, b), definition(a),
    )
    assert base == same
    assert len({base, *others}) == 4


def test_a_definition_diff_matches_clauses_by_key(spark):
    schema = f"check_id int, clauses {lifecycle.CLAUSES}"
    one = definition(("a", "x > 1", None, {"m": "1", "n": "2"}), ("b", "y", None, {}), ("c", "z", "q", {}))
    two = definition(("c", "z", None, {}), ("a", "x > 1", None, {"n": "2", "m": "1"}), ("d", "w", None, {}))
    diff = lifecycle.definition_diff(
        spark.createDataFrame([(1, one)], schema), spark.createDataFrame([(1, two)], schema)
    )
    assert {r.key: r.kind for r in diff.collect()} == {"b": "removed", "c": "changed", "d": "added"}


def test_ids_in_columns_are_those_of_the_spec(spark):
    suite = Suite("db.t", [Check("c", [Clause("failed_rows", where=" a  > 1", options={"condition": "n  < 0"})])])
    check = suite.checks[0]
    clause_id, _, clause = suite.clause_ids()[0]
    one = spark.range(1)
    lit = F.lit
    made = one.select(
        text.check_id(lit("spark"), lit("db.t"), lit("c")).alias("check"),
        text.clause_id(
            lit(suite.check_id(check)), lit(clause.key), lit(" a  > 1"), lit("condition=n  < 0")
        ).alias("clause"),
    ).first()
    assert made.check == suite.check_id(check) == short_hash("check", "spark", "db.t", "c")
    assert made.clause == clause_id
    tighter = Clause("failed_rows", expect=Rule("<", 9), where="a > 1", options={"condition": "n < 0"})
    assert tighter.id_on(suite.check_id(check)) == clause_id
    other = Clause("failed_rows", where="a > 2", options={"condition": "n < 0"})
    assert other.id_on(suite.check_id(check)) != clause_id


def test_nan_satisfies_only_what_excludes(spark):
    rules = [Rule(op, 1) for op in ("=", "!=", "<", "<=", ">", ">=")]
    rules += [Rule("between", 0, 2), Rule("not between", 0, 2)]
    nan = F.lit(float("nan"))
    held = spark.range(1).select(*[judge.rule_holds(nan, r) for r in rules]).first()
    assert list(held) == [False, True, False, False, False, False, False, True]


def test_rule_bounds_with_units():
    assert Rule("<", "2h").as_row() == ("<", 7200.0, None, "< 2h")
    assert Rule("between", "-5%", "5%").as_row()[1:3] == (-5.0, 5.0)
    assert Rule("<", "5%").relative and not Rule("<", 5).relative


def test_the_first_of_equally_bad_outcomes_names_the_run(spark):
    rows = [("a", 0, "skipped"), ("a", 1, "pass"), ("b", 0, "pass"), ("b", 1, "skipped"), ("c", 0, "pass"), ("c", 1, "odd")]
    df = spark.createDataFrame(rows, "run_id string, position int, outcome string")
    rolled = {r.run_id: (r.outcome, r.exit_code) for r in judge.run_rollup(df).collect()}
    assert rolled == {"a": ("skipped", 0), "b": ("pass", 0), "c": ("error", 2)}


def test_pending_alerts_that_are_no_news(spark):
    hour = timedelta(hours=1)
    runs = [(f"r{i}", "p", "k", START + i * hour) for i in range(4)] + [("x", "p", None, START)]
    # delivery, run, check, event, sent, attempts
    told = [
        (1, "r0", 1, "failing", None, 0),
        (2, "r2", 1, "recovered", None, 0),
        (3, "r0", 2, "failing", START, 1),
        (4, "r2", 2, "recovered", None, 5),
        (5, "r1", 3, "erroring", None, 0),
        (6, "x", 4, "failing", None, 0),
    ]
    rows = [(i, r, c, "chat", e, None, START, n, s, None) for i, r, c, e, s, n in told]
    deliveries = spark.createDataFrame(
        rows,
        "delivery_id int, run_id string, check_id int, notifier string, event string, previous_outcome string, "
        "created_at timestamp, attempts int, sent_at timestamp, abandoned_at timestamp",
    )
    of = spark.createDataFrame(runs, "run_id string, project string, run_key string, started_at timestamp")
    now = F.lit(START + 5 * hour).cast("timestamp")
    found = alerts.alerts_pending(deliveries, of, now).collect()
    assert {r.delivery_id: (r.superseded, r.expired) for r in found} == {
        1: (True, False), 2: (True, False), 4: (False, True), 5: (False, False),
    }


def test_globs_and_paths(spark):
    paths = ["checks/a/x.yml", "checks/a.yml", "checks/ab/y.yml", "other/[z].yml"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")

    def kept(condition):
        return [r.path for r in df.where(condition).collect()]

    assert kept(search.under("checks/a")) == ["checks/a/x.yml"]
    assert kept(search.under("")) == paths
    assert kept(search.excluded("checks/a*")) == paths[:3]
    assert kept(search.excluded("*/[!x].yml")) == paths[1:3]
    assert kept(search.excluded("checks/a?/*.yml")) == ["checks/ab/y.yml"]


def test_common_folder(spark):
    def folder(*paths):
        df = spark.createDataFrame([(p,) for p in paths], "path string")
        return rollups.common_folder(df).first().folder

    assert folder("checks/a/x.yml", "checks/a/y.yml") == "checks/a"
    assert folder("checks/a/x.yml", "checks/ab/y.yml") == "checks"
    assert folder("checks/a.yml") == "checks"
    assert folder("checks/a.yml", "shared/b.yml") == ""


def test_durations_and_values(spark):
    cases = {0.0: "0s", 59.6: "1m", 3600.0: "1h", 7955.0: "2h 12m", -25200.0: "-7h", 90061.0: "1d 1h"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s double, wanted string")
    got = df.select("wanted", text.format_duration(F.col("s")).alias("got")).collect()
    assert all(r.got == r.wanted for r in got), got
    shown = spark.range(1).select(
        text.format_value(F.lit("count"), F.lit(1234.0)),
        text.format_value(F.lit("percent"), F.lit(12.345)),
        text.format_value(F.lit("number"), F.lit(20.5)),
        text.format_value(F.lit("number"), F.lit(None).cast("double")),
    )
    assert list(shown.first()) == ["1,234", "12.35%", "20.5", "—"]


def test_problems_come_first(spark):
    outcomes = ["pass", None, "fail", "skipped", "error", "warn", "fail"]
    df = spark.createDataFrame(list(enumerate(outcomes)), "check_id int, outcome string")
    listed = rollups.problems_first(df, "check_id").collect()
    assert [r.check_id for r in listed] == [2, 6, 4, 5, 1, 3, 0]


def test_top_values_and_facets(spark):
    rows = [(i, ["b"] if i % 3 else ["A", ""], None if i < 2 else "me", "s", "pass") for i in range(6)]
    df = spark.createDataFrame(
        rows, "check_id int, tags array<string>, owner string, datasource string, outcome string"
    )
    df = df.withColumns({c: F.lit("x") for c in ("name", "expression", "dataset", "path", "check_hash")})
    counts = search.facet_counts(df, "tag", chosen={"tag": ["b"], "owner": ["me"]})
    assert [tuple(r) for r in search.top_values(counts).collect()] == [("b", 3), ("A", 1)]
    owners = search.facet_counts(df, "owner", chosen={"owner": ["me"]})
    assert [tuple(r) for r in search.top_values(owners).collect()] == [("me", 4), ("", 2)]
    assert search.facet_filter(df, chosen={"owner": [""]}).count() == 2
