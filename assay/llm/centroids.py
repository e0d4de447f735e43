"""Clusters of vectors around centroids, each vector's nearest found by the threshold algorithm.

Vectors are whole numbers, so that distances, sums and means are exact and a rerun gives
the same. A round assigns every vector to its nearest centroid and then moves each
centroid to the floor of its vectors' mean; one without vectors stays.

For every dimension the centroids are sorted by their value there. A vector is placed
into each list and walks outward, in all dimensions at once, always to the nearer of the
two neighbours: the frontier. A centroid met for the first time is measured exactly. One
not met yet is, in every dimension, at least as far as the frontier; once the sum of
the squared frontier distances strictly exceeds the best exact distance no such centroid can
be as near, and the walk ends. Ties therefore always show: they go to the smaller number.

* A vector is kept if it has `size` components, none null or not finite; others, and null
  vectors, are left out. Its components x become floor(1024 * x), x as double.
* The first centroids are the vectors with the smallest lower-case hexadecimal SHA-256 of
  `3:` and their decimal vec_id; of equal ids the smaller components come first, a null id after all
  others. With fewer vectors there are as many centroids as vectors, and none without any.
* Repeated rows are vectors each, and count as often. Other columns are ignored.
* A component beyond 2**27 in size, whose distances no longer fit, is refused.
* The driver gets the centroids and, each round, a row of sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
LARGEST = 1 << 27
#: Vectors walked at a time in a task.
ROWS = 1 << 12


def whole_vectors(
    embeddings: DataFrame, vector: str = "embedding", size: int = SIZE, scale: int = SCALE
) -> DataFrame:
    """vec_id, v: the vectors kept, as whole numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.lit(2.0 * LARGEST)

    def floor(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * scale, most), -most))

    kept = embeddings.where((F.size(x) == size) & finite)
    whole = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))
    said = F.concat(F.lit("a component is too large: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    fits = F.forall("v", lambda c: F.abs(c) <= LARGEST)
    return whole.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error(said)).alias("v"))


def first_centroids(vectors: DataFrame, many: int = CENTROIDS) -> np.ndarray:
    """The vectors that centroids start as, in the order of their hashes."""
    named = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", named.alias("name")).orderBy(F.col("name").asc_nulls_last(), "v").limit(many)
    found = [r["v"] for r in rows.collect()]
    return np.array(found, dtype=np.int64)


class Lists:
    """The centroids sorted by their value in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension, place
        self.values = np.take_along_axis(centroids, self.order.T, axis=0).T.copy()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """By vector the nearest centroid and its squared distance; then how many steps were walked."""
        n, dims = vectors.shape
        many = len(self.centroids)
        best = np.full(n, np.iinfo(np.int64).max)
        at = np.full(n, many)
        met = np.zeros((n, many), dtype=bool)
        # The next places to the right and left of each vector, in each list.
        right = np.empty((n, dims), dtype=np.int64)
        for d in range(dims):
            right[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        left = right - 1
        walking = np.arange(n)
        dim = np.arange(dims)
        far = np.iinfo(np.int64).max
        steps = 0
        while len(walking):
            steps += len(walking)
            own, r, l = vectors[walking], right[walking], left[walking]
            gap_r = np.where(r < many, self.values[dim, np.minimum(r, many - 1)] - own, far)
            gap_l = np.where(l >= 0, own - self.values[dim, np.maximum(l, 0)], far)
            rightward = gap_r <= gap_l
            place = np.where(rightward, r, l)
            frontier = np.where(rightward, gap_r, gap_l)
            right[walking] = r + rightward
            left[walking] = l - ~rightward
            self._measure(vectors, walking, self.order[dim, place], met, best, at)
            threshold = (frontier * frontier).sum(axis=1)
            walking = walking[(threshold <= best[walking]) & ~met[walking].all(axis=1)]
        return at, best, steps

    def _measure(self, vectors, walking, found, met, best, at) -> None:
        """Exact distances of the centroids `found` that a vector meets for the first time."""
        now = np.zeros((len(walking), len(self.centroids)), dtype=bool)
        np.put_along_axis(now, found, True, axis=1)
        rows, numbers = np.nonzero(now & ~met[walking])
        rows = walking[rows]
        met[rows, numbers] = True
        gaps = vectors[rows] - self.centroids[numbers]
        exact = (gaps * gaps).sum(axis=1)
        for number in np.unique(numbers):
            own = numbers == number
            row, distance = rows[own], exact[own]
            nearer = (distance < best[row]) | ((distance == best[row]) & (number < at[row]))
            best[row[nearer]], at[row[nearer]] = distance[nearer], number


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            yield batch.slice(first, ROWS)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round over all vectors."""
    many, dims = centroids.shape
    names = [f"s{d}" for d in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        counts = np.zeros(many, dtype=np.int64)
        sums = np.zeros((many, dims), dtype=np.int64)
        for batch in _pieces(batches):
            found = _matrix(batch.column(0))
            at, _, _ = lists.nearest(found)
            counts += np.bincount(at, minlength=many)
            np.add.at(sums, at, found)
        has = np.flatnonzero(counts)
        columns = [pa.array(has), pa.array(counts[has]), *[pa.array(s) for s in sums[has].T]]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    parts = vectors.select("v").mapInArrow(run, ", ".join(f"{c} long" for c in ["cluster", "n", *names]))
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    out = centroids.copy()
    for row in rows.collect():  # one per centroid
        out[row["cluster"]] = [row[c] // row["n"] for c in names]
    return out


def clustered(
    embeddings: DataFrame,
    many: int = CENTROIDS,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector kept, and the final centroids.

    The vectors are written once as whole numbers, and every round reads them there.
    """
    vectors = cut_lineage(whole_vectors(embeddings, vector, size, scale))
    centroids = first_centroids(vectors, many)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        after = moved(vectors, centroids)
        if np.array_equal(after, centroids):
            break  # further rounds would change nothing
        centroids = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in _pieces(batches):
            at, distance, _ = lists.nearest(_matrix(batch.column(1)))
            columns = [batch.column(0), pa.array(at.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    schema = "vec_id long, cluster int, distance long"
    return cut_lineage(vectors.select("vec_id", "v").mapInArrow(run, schema)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignments with the inertia of their cluster and of all, and the centroid's digest."""
    sums = {r["cluster"]: r["sum"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")).cast(kind)

    each = [sums.get(i, 0) for i in range(len(centroids))]
    return assigned.withColumns(
        {
            "cluster_inertia": of_cluster(each, "long"),
            "inertia": F.lit(sum(each)).cast("long"),
            "centroid_sha256": of_cluster(digests, "string"),
        }
    )
