import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from assay.llm import centroids


def plain(rows, many, rounds, size):
    """(vec_id, cluster, distance) sorted, and the centroids, by measuring every distance."""
    kept = [
        (i, [int(np.floor(1024 * float(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)
    ]

    def name(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    now = [v for _, v in sorted(kept, key=name)[:many]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        now = [
            [sum(x) // len(x) for x in zip(*own, strict=True)] if own else c
            for c, own in ((c, [v for (_, v), a in zip(kept, at, strict=True) if a == k]) for k, c in enumerate(now))
        ]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    return sorted(found, key=str), now


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, v int")
    assigned, found = centroids.clustered(df, **options)
    return sorted(map(tuple, assigned.collect()), key=str), found, assigned


@pytest.mark.parametrize(("many", "size", "spread"), [(8, 6, 1.0), (3, 2, 0.004), (5, 1, 0.01)])
def test_clusters_are_those_of_measuring_every_distance(spark, many, size, spread):
    rng = np.random.default_rng(many)
    rows = [(int(i), (rng.normal(size=size) * spread).astype(np.float32).tolist()) for i in rng.permutation(150)]
    rows += rows[:10]
    got, found, _ = clusters(spark, rows, many=many, size=size, rounds=4)
    assert (got, found.tolist()) == plain(rows, many, 4, size)


def test_nulls_wrong_sizes_ties_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (None, [0.5, 0.5]), (7, [0.0, 1.0]), (7, [0.0, 0.0]), (8, [0.0, 0.0])]
    got, found, assigned = clusters(spark, rows, many=8, size=2, rounds=3)
    assert (got, found.tolist()) == plain(rows, 8, 3, 2)
    assert len(got) == 4 and len(found) == 4
    told = centroids.with_inertia(assigned, found).collect()
    assert {r.inertia for r in told} == {sum(d for _, _, d in got)}
    for r in told:
        assert r.cluster_inertia == sum(d for _, c, d in got if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, found[r.cluster].tolist())).encode()).hexdigest()


def test_no_vectors_give_no_rows(spark):
    for rows in ([], [(1, None)]):
        got, found, assigned = clusters(spark, rows)
        assert got == [] and not len(found)
        assert centroids.with_inertia(assigned, found).collect() == []


def test_a_component_too_large_is_refused(spark):
    with pytest.raises(PySparkException, match="too large: vec_id 3"):
        clusters(spark, [(3, [1e30, 0.0])], size=2)


def test_the_walk_ends_early_and_misses_no_tie():
    lists = centroids.Lists(np.array([[0, 0], [10, 10], [10, 10], [500, 500], [900, -900]]))
    at, distance, steps = lists.nearest(np.array([[9, 9], [5, 5], [0, 1], [499, 500]]))
    assert at.tolist() == [1, 0, 0, 3] and distance.tolist() == [2, 50, 1, 1]
    assert steps < 4 * 5
    rng = np.random.default_rng(1)
    for _ in range(200):
        k, d = rng.integers(1, 12), rng.integers(1, 5)
        spots, vectors = rng.integers(-4, 5, (k, d)), rng.integers(-4, 5, (30, d))
        full = ((vectors[:, None] - spots[None]) ** 2).sum(axis=2)
        at, distance, _ = centroids.Lists(spots).nearest(vectors)
        assert at.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()
