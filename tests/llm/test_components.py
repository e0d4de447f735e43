import random

from assay.llm.components import components


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in components(df).collect()}


def test_chains_stars_loops_and_repeats(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain[:-1], chain[1:], strict=True))
    edges += [(1, i) for i in range(2, 50)] + [(60, 60), (70, 71), (71, 70), (70, 71)]
    got = found(spark, edges)
    assert {got[i] for i in chain} == {100}
    assert {got[i] for i in range(1, 50)} == {1}
    assert got[70] == got[71] == 70 and 60 not in got


def test_nulls_and_no_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 1), (2, None)]) == {}
