from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copy string, _nth int")


def rows_of(source, sizes, first=0):
    return [(first + i, source, "w " * n, "c", 1) for i, n in enumerate(sizes)]


def test_targets_share_by_weight_and_stop_at_twice_the_source(spark):
    rows = rows_of("a", [100]) + rows_of("b", [500], 10) + rows_of("c", [400], 20)
    got = {r.source: r for r in mixing.targets(mixing.sized(table(spark, rows))).collect()}
    # 1,500 words by 3, 1, 2: a stops at 200, the other 1,300 go 1 to 2, c stops at 800.
    assert {s: r.target for s, r in got.items()} == pytest.approx({"a": 200, "b": 500, "c": 800})
    assert {s: r.source_size for s, r in got.items()} == {"a": 100, "b": 500, "c": 400}


def test_the_null_source_comes_last_and_sources_without_words_take_none(spark):
    rows = rows_of("a", [10]) + rows_of("b", [0], 5) + rows_of(None, [10], 9)
    got = {r.source: r.target for r in mixing.targets(mixing.sized(table(spark, rows))).collect()}
    assert got == {"a": 18.0, "b": 0.0, None: 12.0}


def test_words_taken_come_near_the_target(spark):
    sizes = [1 + (i * 7919) % 300 for i in range(400)]
    rows = rows_of("a", sizes) + rows_of("b", sizes[:100], 1000) + rows_of("c", [5000, 3], 2000)
    plan = mixing.allotted(table(spark, rows)).withColumn("taken", F.col("size") * F.col("copies"))
    for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.w) <= 2 * r.m
    assert plan.where("copies > 2 or copies < 0").isEmpty()


def test_a_mix_repeats_itself_and_numbers_copies(spark):
    rows = rows_of("a", range(1, 50)) + rows_of("b", [5, 5, 5], 100) + rows_of("b", [5], 100)
    df = table(spark, rows)
    one, two = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert one == two
    # The table has a column of that name, which stays.
    assert mixing.mix(df).columns == [*df.columns, "copy_"]
    assert {r["copy"] for r in mixing.mix(df).collect()} == {"c"}
    plan = mixing.allotted(df)
    assert len(one) == plan.agg(F.sum("copies")).first()[0]
    want = Counter()
    for r in plan.collect():
        want[r.doc_id] += r.copies
    assert Counter(r[0] for r in one) == +want


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "a", "", None, None), (1, "a", "x y\x0bz\x85q", "c", 2)]
    got = sorted((r.size, r.doc_id) for r in mixing.allotted(table(spark, rows)).collect() if r.doc_id)
    assert got == [(0, 1), (3, 1)]
    assert mixing.mix(table(spark, rows)).where("doc_id is null").count() <= 1
    assert mixing.mix(table(spark, rows[:0])).collect() == []
    assert mixing.allotted(table(spark, rows[:0])).collect() == []


def test_a_seed_moves_the_offset_only(spark):
    df = table(spark, rows_of("a", range(1, 200)))
    totals = {s: sum(r.copies for r in mixing.allotted(df, seed=s).collect()) for s in (1, 2)}
    assert abs(totals[1] - totals[2]) <= 1
