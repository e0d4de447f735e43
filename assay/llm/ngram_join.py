"""N-gram Jaccard self-join: universe partition with pigeonhole signatures.

Sets of word shingles link at a Jaccard similarity of `PERCENT` or more. Two
linked sets of x and y shingles differ in at most H = (x + y) (1 - j) / (1 + j)
shingles.

* Size bands. A window starts at each power of `RATIO`; it joins sets from there up
  to the next with any set up to 1/j times as large. A set is in one or two
  windows, and every linked pair meets in that of its smaller set.
* Segments. In a window, shingles are dealt by hash to m segments. Of these, d are
  matched up to one deletion and the others exactly.
* Pigeonhole. If no one-deletion segment matches, those hold at least 2d of the H
  differences, and at least m + d - H of the m - d exact segments are equal. With
  exact segments in one order for all sets, the first of the equal ones is
  among the first H - 2d + 1 of either set. So a set emits the deletion
  neighbourhood of its d segments and its first H - 2d + 1 exact segments.
* Cost-based allocation. A segment costs what its rarest shingle is common; that
  order puts the segments of passages that many documents share, and empty ones,
  last, and sets leave out the costliest. How common shingles are is counted over
  all sets, in counters of a fixed number. m and d are chosen for every window by
  the signatures they make and the false matches expected from the number of
  sets there, see `allocated`.
* Sets with a signature in common are candidates. Each set has a parity bitmap of two
  to four bits per shingle; two bitmaps never differ in more bits than the sets differ in
  shingles, so most false candidates go by these. What is left is verified on the
  shingles.

Equal sets are one class before anything else. Of a group of near copies not all
pairs are made: each set is first verified against one pivot of its signatures, a
set that meets the most others. Signatures that by then hold one component only
are done. In the others all pairs of different components are compared by bitmaps, a block of sets against
the rest at a time. What leaves a block is which sets may link with any other, a row per set. The shingles of
those alone are dealt to blocks again and verified there, each pair at the first signature it shares; a
link joins its components within the block, so only links that join any leave it, and every linked pair of
different components is met in the end.

* Words are split at ASCII white space, A to Z lower-cased. A set has the distinct
  shingles of five words; a text with fewer words has one, the whole sequence. Null,
  empty and blank texts have none and link with nothing.
* Rows of equal doc_id are judged one by one, each by its own text. A row with a null
  id comes back with the component of equal sets that have an id, else with null,
  and brings nothing together. An empty table gives no rows.
* Classes are told apart by a number of their own, not by an id: sets of one id that
  do not link stay in two components, which then have the same component_id.
* Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, fresh
from assay.llm.components import components
from assay.llm.words import NOT_BLANK, Words, chunks, encoded, mixed, sets

PERCENT = 75
RATIO = 2.0
#: Exact segments more than needed, so that sets can leave out the smallest: shares tried.
SPARE = (0.35, 0.5, 0.75)
#: Segments with no more shingles than this are taken to be shared by chance.
COMMON = 1
#: Shingles are counted in so many counters, whatever their number.
COUNTERS = 1 << 18
#: The count of no shingle at all: above any other.
NEVER = 1 << 38
#: Signatures that one false match costs as much as.
MATCH_COST = 50.0


def differing(size_a: np.ndarray, size_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The most shingles in which linked sets of these sizes differ."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Band:
    """A size band: sets of at least `low`, and less than `high`, with larger partners."""

    number: int
    low: int
    high: int
    top: int  # the largest partner
    segments: int
    deletions: int


def largest_partner(sizes: np.ndarray, high: int, top: int, percent: int) -> np.ndarray:
    """The largest set that a set of a window has to meet there.

    A set at or above `high` is the larger of its pairs there, any other either.
    """
    return np.maximum(np.where(sizes >= high, high - 1, np.minimum(sizes * 100 // percent, top)), 1)


def binomial(sizes: np.ndarray, segments: int, shingles: int) -> np.ndarray:
    """How likely a segment gets so many of the shingles of a set (0 to 2)."""
    ways = (1.0, sizes, sizes * (sizes - 1) / 2)[shingles]
    rest = np.maximum(sizes - shingles, 0)
    return ways * (1 / segments) ** shingles * (1 - 1 / segments) ** rest


def allocated(
    number: int, sets_there: int, percent: int = PERCENT, ratio: float = RATIO
) -> Band:
    """The segments of a window, by cost.

    For each choice the cost is the signatures of a set, and the pairs expected to
    share an emitted segment by chance: exact segments with `COMMON` shingles at
    most, and one-deletion segments with one at most, when shingles are
    thrown into segments; both as means over sizes from `low` to `top`.
    """
    low, high = math.ceil(ratio**number), math.ceil(ratio ** (number + 1))
    top = max((high - 1) * 100 // percent, low)
    most = int(differing(np.int64(high - 1), np.int64(top), percent))
    sizes = np.unique(np.array([low, (low + high) // 2, high - 1, (high + top) // 2, top]))
    sizes = sizes[(sizes >= low) & (sizes <= top)]
    usual = differing(sizes, largest_partner(sizes, high, top, percent), percent)
    best = None
    half = (most + 1) // 2
    for deletions in sorted({0, 1, 2, 3, half // 4, half // 2, half} & {*range(half + 1)}):
        exact = most - 2 * deletions + 1
        for spare in sorted({math.ceil(exact * s) for s in SPARE}):
            segments = deletions + exact + spare
            emitted = np.maximum(usual - 2 * deletions + 1, 0)
            signatures = deletions * (1 + sizes / segments) + emitted
            few = [binomial(sizes, segments, k) for k in range(3)]
            left_out = segments - deletions - emitted
            chance = (segments - deletions) * sum(few[: COMMON + 1]) - left_out
            chance = np.maximum(chance, 0.0) / segments
            chance = chance + deletions * (few[0] + few[1])
            cost = float(np.mean(signatures + MATCH_COST * chance * sets_there / 2))
            if best is None or cost < best[0]:
                best = (cost, segments, deletions)
    return Band(number, low, high, top, best[1], best[2])


def counter_of(found: np.ndarray) -> np.ndarray:
    return (mixed(found) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def set_keys(found: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every whole set; 0 for empty ones."""
    ends = np.concatenate(([0], np.cumsum(many)))
    one, two = np.zeros(len(many), np.uint64), np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        opens = ends[:-1][full]
        one[full] = mixed(np.add.reduceat(mixed(found), opens))
        two[full] = mixed(np.add.reduceat(mixed(found ^ np.uint64(0x5DEECE66D)), opens))
    return one, two


def signatures(
    found: np.ndarray,
    many: np.ndarray,
    windows: dict[int, Band],
    percent: int = PERCENT,
    common: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """The set and the value of each signature of some sets.

    `common` tells how many sets have shingles of each counter, see `common_shingles`.
    """
    if common is None:
        common = np.zeros(COUNTERS, dtype=np.int64)
    rows, sigs = [], []
    ends = np.cumsum(many)
    starts = ends - many
    for window in windows.values():
        inside = np.flatnonzero((many >= window.low) & (many <= window.top))
        if not len(inside):
            continue
        sizes = many[inside]
        partner = largest_partner(sizes, window.high, window.top, percent)
        most = differing(sizes, partner, percent)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = found[np.repeat(starts[inside], sizes) + at]
        own = np.repeat(np.arange(len(inside)), sizes)
        m, d = window.segments, window.deletions
        salt = mixed(np.array([window.number], dtype=np.uint64))
        dealt = mixed(held + salt)
        segment = ((dealt >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        cell = own * m + segment
        value = mixed(dealt ^ np.uint64(0xA5A5A5A55A5A5A5A))
        sums = np.zeros(len(inside) * m, dtype=np.uint64)
        np.add.at(sums, cell, value)
        places = np.tile(np.arange(m, dtype=np.uint64), len(inside))
        whole = mixed(sums + mixed(places + salt))
        if d:
            # One-deletion segments: all of it, and all but one shingle.
            first = places < d
            rows.append(np.repeat(np.arange(len(inside)), m)[first])
            sigs.append(whole[first])
            short = segment < d
            rows.append(own[short])
            sigs.append(mixed(sums[cell[short]] - value[short] + mixed(places[cell[short]] + salt)))
            rows[-2:] = [inside[r] for r in rows[-2:]]
        emitted = np.minimum(np.maximum(most - 2 * d + 1, 0), m - d)
        if m > d:
            # Segments with the rarest shingle first, empty ones last, equal ones by content.
            rarest = np.full(len(inside) * m, NEVER, dtype=np.int64)
            np.minimum.at(rarest, cell, common[counter_of(held)])
            rarest[places < d] = NEVER + 1
            tie = (whole >> np.uint64(40)).astype(np.int64)
            rank = np.argsort(((rarest << np.int64(24)) + tie).reshape(-1, m), axis=1, kind="stable")
            taken = np.arange(m)[None, :] < emitted[:, None]
            cells = (np.arange(len(inside))[:, None] * m + rank)[taken]
            rows.append(inside[cells // m])
            sigs.append(whole[cells])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def bitmaps(found: np.ndarray, many: np.ndarray) -> pa.Array:
    """The parity bitmap of every set: which bits an odd number of shingles falls on."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * many, 64))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(bits)))
    own = np.repeat(np.arange(len(many)), many)
    at = mixed(found) & (bits[own] - 1).astype(np.uint64)
    count = np.bincount(ends[own] + at.astype(np.int64), minlength=int(ends[-1]))
    data = np.packbits((count & 1).astype(np.uint8)).tobytes()
    offsets = pa.py_buffer((ends // 8).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(many), [None, offsets, pa.py_buffer(data)])


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; the longer is folded to the shorter's length."""
    one, two = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    folded = np.bitwise_xor.reduce(two.reshape(-1, len(one)), axis=0)
    return int(np.bitwise_count(one ^ folded).sum())


BLOCKS = 64
ROWS = (
    "doc_id long, text_hash long, n_shingles long, key long, key2 long, bits binary, block int"
)


def set_rows(documents: DataFrame) -> DataFrame:
    """See ROWS: a row per document, and the shingle counters of each task.

    Documents have a null block, and null keys and bits if the set is empty. Rows
    with a block hold a part of a task's counters in `bits`.
    """
    names = [field.split()[0] for field in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for first, last in chunks(batch.column(2)):
                part = batch.slice(first, last - first)
                found, many = sets(Words(encoded(part.column(2)), NOT_BLANK))
                counters += np.bincount(counter_of(found), minlength=COUNTERS)
                none = pa.array(many == 0)
                keys = [
                    pc.if_else(none, pa.scalar(None, pa.int64()), _long(k))
                    for k in set_keys(found, many)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array(many, pa.int64()),
                        *keys,
                        bitmaps(found, many),
                        pa.nulls(len(part), pa.int32()),
                    ],
                    names,
                )
        if counters.any():
            parts = [c.tobytes() for c in np.split(counters, BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.nulls(BLOCKS, pa.int64())] * 5,
                    pa.array(parts, pa.binary()),
                    pa.array(range(BLOCKS), pa.int32()),
                ],
                names,
            )

    given = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(run, ROWS)


def common_shingles(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks together: how many sets have shingles of each.

    They decide which segments come first, and nothing else, so shingles may share
    a counter. What the driver gets has a fixed size.
    """

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("bits").to_pylist())
        return pa.table({"block": table.column("block")[:1], "bits": [total.tobytes()]})

    parts = rows.where("block is not null").select("block", "bits")
    found = parts.groupBy("block").applyInArrow(summed, "block int, bits binary").toArrow()
    counters = np.zeros((BLOCKS, COUNTERS // BLOCKS), dtype=np.int64)
    for block, bits in zip(*(found.column(c).to_pylist() for c in ("block", "bits")), strict=True):
        counters[block] = np.frombuffer(bits, np.int64)
    return counters.reshape(-1)


def signature_rows(
    documents: DataFrame, windows: dict[int, Band], percent: int, common: np.ndarray
) -> DataFrame:
    """sig, key: the signatures of every set, once for each task that meets the set."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for first, last in chunks(batch.column(0)):
                part = batch.column(0).slice(first, last - first)
                found, many = sets(Words(encoded(part), NOT_BLANK))
                one, _ = set_keys(found, many)
                # Copies have the same signatures.
                _, firsts = np.unique(one, return_index=True)
                new = np.zeros(len(one), dtype=bool)
                new[firsts] = True
                new &= (many > 0) & ~np.isin(one, seen)
                seen = np.union1d(seen, one[new])
                keep = np.repeat(new, many)
                rows, sigs = signatures(found[keep], many[new], windows, percent, shared.value)
                own = one[new][rows]
                for at in range(0, len(sigs), 50_000):
                    upto = at + 50_000
                    yield pa.RecordBatch.from_arrays(
                        [_long(sigs[at:upto]), _long(own[at:upto])], ["sig", "key"]
                    )

    return documents.select("text").mapInArrow(run, "sig long, key long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, n, shingles from (node, key, text), where the text has the set of that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in chunks(batch.column(2)):
                part = batch.slice(first, last - first)
                found, many = sets(Words(encoded(part.column(2)), NOT_BLANK))
                one, _ = set_keys(found, many)
                ends = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), _long(found))
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(many, pa.int64()), held], ["node", "n", "shingles"]
                )
                yield out.filter(pc.equal(part.column(1), _long(one)))

    schema = "node long, n long, shingles array<long>"
    return texts.select("node", "key", "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    a = held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    b = held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    alike = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent
    return pairs.join(a, "a").join(b, "b").where(alike).select("a", "b")


def band_column(size: Column, ratio: float = RATIO) -> Column:
    """The number of the last window that starts at or below a size."""
    starts: dict[int, int] = {}
    for number in range(math.ceil(math.log(2**40) / math.log(ratio))):
        starts[math.ceil(ratio**number)] = number
    band = F.lit(0)
    for start, number in starts.items():
        band = F.when(size >= start, number).otherwise(band)
    return band


def met_signatures(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, node: signatures of two classes at least, a row for each class."""
    same = Window.partitionBy("sig").orderBy("key")
    before, after = F.lag("key", 1).over(same), F.lead("key", 1).over(same)
    met = sigs.withColumns({"first": F.first("key").over(same), "before": before, "after": after})
    # A set may come from several tasks: the first of equal rows is kept, if the
    # signature has another key, before or after.
    new = F.col("before").isNull() | (F.col("before") != F.col("key"))
    other = (F.col("first") != F.col("key")) | F.col("after").isNotNull()
    met = met.where(new & other).select("sig", "key")
    named = classes.select("key", "node")
    return met.join(named, "key").select("sig", "node")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, more columns) whose bitmaps leave it open whether the sets link."""
    a = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("_n_a"), F.col("bits").alias("_b_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("_n_b"), F.col("bits").alias("_b_b"))
    schema = pairs.schema
    kept = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, b_a, n_b, b_b = batch.columns[kept:]
            most = differing(np.asarray(n_a), np.asarray(n_b), percent)
            apart = [bits_apart(x, y) for x, y in zip(b_a.to_pylist(), b_b.to_pylist(), strict=True)]
            rows = pa.RecordBatch.from_arrays(batch.columns[:kept], schema.names)
            yield rows.filter(pa.array(np.array(apart, dtype=np.int64) <= most))

    joined = pairs.join(a, "a").join(b, "b")
    return joined.select(*schema.names, "_n_a", "_b_a", "_n_b", "_b_b").mapInArrow(run, schema)


def components_of(
    documents: DataFrame,
    classes: DataFrame,
    windows: dict[int, Band],
    common: np.ndarray,
    percent: int,
) -> DataFrame:
    """node, component: the components of classes, by their smallest nodes.

    Links that would not join components any more are not looked for.
    """
    sigs = signature_rows(documents, windows, percent, common)
    rows = cut_lineage(met_signatures(sigs, classes))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "key", "rep", "rep_text")
        chosen = cut_lineage(wanted.join(nodes.distinct(), "node", "left_semi"))
        likely = among(documents.select("doc_id", "text"), "doc_id", chosen, "rep")
        # An id may have several texts.
        its = (F.col("doc_id") == F.col("rep")) & (F.xxhash64("text") == F.col("rep_text"))
        return cut_lineage(shingle_sets(likely.join(chosen, its)))

    pairs = cut_lineage(to_pivots(rows, classes, percent))
    if pairs.isEmpty():
        return components(pairs)
    held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = cut_lineage(verified(pairs, held, percent))
    merged = cut_lineage(components(links))
    rows = cut_lineage(crossing(unsettled(rows, merged), classes, percent).distinct())
    rows = cut_lineage(apart_signatures(rows))
    if rows.isEmpty():
        return merged
    held = sets_of(rows.select("node"))
    return components(links.unionByName(cut_lineage(crossing_links(rows, classes, held, percent))))


def to_pivots(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with one pivot of its signatures.

    A signature's pivot is the class that meets the most others over all its
    signatures: in a group of near copies, the text that they were made from. Of the
    pivots that may link, a class takes the one of most signatures, then the smallest.
    """
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    sized = cut_lineage(rows.join(sizes, "sig"))
    scores = sized.groupBy("node").agg(F.sum("size").alias("score"))
    scored = sized.select("sig", "node").join(scores, "node")
    best = F.max_by("node", F.struct("score", -F.col("node"))).alias("pivot")
    pivots = scored.groupBy("sig").agg(best)
    beside = sized.select("sig", "node").join(pivots, "sig").where("node <> pivot")
    shared = beside.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("times"))
    counted = shared.select(F.col("node").alias("a"), F.col("pivot").alias("b"), "times")
    open_pairs = plausible(counted, classes, percent)
    favoured = open_pairs.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))
    return favoured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Words of 64 bits in the filter of `among`: 8 MB, whatever the number of ids.
FILTER_WORDS = 1 << 20


def among(df: DataFrame, column: str, wanted: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is likely among the wanted ones; none of those is left out.

    A bit per hash of a wanted id, in a filter of fixed size: it keeps texts that
    no join would keep out of the shuffle. With very many ids it lets more
    through, and the join that follows still decides.
    """
    hashed = F.xxhash64(id_column)
    word = F.pmod(hashed, F.lit(FILTER_WORDS)).alias("word")
    place = F.shiftrightunsigned(hashed, 58).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = wanted.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def likely(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy().astype(np.int64)
        bits = shared.value[at & (FILTER_WORDS - 1)].view(np.uint64)
        return pd.Series((bits >> (at.view(np.uint64) >> np.uint64(58))) & np.uint64(1) == 1)

    return df.where(likely(F.xxhash64(column)))


def unsettled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """sig, node, component of the signatures that hold several components."""
    named = merged.withColumnRenamed("component", "its")
    own = F.coalesce("its", "node").alias("component")
    known = cut_lineage(rows.join(named, "node", "left").select("sig", "node", own))
    spread = known.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    return cut_lineage(known.join(spread.where("low <> high").select("sig"), "sig", "left_semi"))


#: Classes of a block, and their shingles where these are dealt to it; a class counts as `LIGHT` at least.
BLOCK = 2048
LIGHT = 200


def in_blocks(rows: DataFrame, weight: Column, size: int) -> DataFrame:
    """rows with place, block: the classes of a signature in order, a row for every block to go to.

    A block takes classes up to `size` of weight, which none has more of. It holds them and
    meets all that follow, which go to every block before theirs. So a task holds one
    block, and a signature with very many classes is many blocks. Most have one.
    """
    before = Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(weight.cast("long")).over(before), F.lit(0))
    last = F.floor(F.col("place") / size).cast("int")
    placed = rows.withColumn("place", place)
    return placed.withColumn("block", F.explode(F.sequence(F.lit(0), last)))


def block_parts(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[tuple[int, bool, np.ndarray, pa.RecordBatch]]:
    """The signature, whether a block begins, which rows it holds, and rows of one block.

    Batches begin with sig, block, place and are sorted by them.
    """
    key = None
    for batch in batches:
        sig, block, place = (batch.column(i).to_numpy() for i in range(3))
        change = np.flatnonzero((sig[1:] != sig[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = [0, *change.tolist(), len(sig)]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if first < last:
                begins = key != (sig[first], block[first])
                key = (sig[first], block[first])
                inside = place[first:last] < (key[1] + 1) * size
                yield key[0], begins, inside, batch.slice(first, last - first)


def crossing(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """sig, node, component: classes that may link with one of their signature in another component."""
    bits = classes.select("node", F.col("n_shingles").alias("n"), "bits")
    placed = in_blocks(rows.select("sig", "node", "component"), F.lit(1), BLOCK)
    dealt = placed.join(bits, "node").select(
        "sig", "block", "place", "node", "component", "n", "bits"
    )
    dealt = dealt.repartition("sig", "block").sortWithinPartitions("sig", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = Held(), np.zeros(0, np.int64)
        for sig, begins, inside, part in block_parts(batches, BLOCK):
            if begins:
                held, told = Held(), np.zeros(0, np.int64)
            node, component, n = (part.column(i).to_numpy() for i in (3, 4, 5))
            some = np.zeros(len(held.node) + int(inside.sum()), dtype=bool)
            new = np.zeros(len(node), dtype=bool)
            for i, j in held.met(node, component, n, part.column(6).to_pylist(), inside, percent):
                some[i] = new[j] = True
            # Rows inside are both held and new.
            found = np.unique(np.concatenate((held.node[some], node[new])))
            found = found[~np.isin(found, told)]
            if len(found):
                told = np.concatenate((told, found))
                named = np.concatenate((held.node, node)), np.concatenate((held.component, component))
                order = np.argsort(named[0], kind="stable")
                at = order[np.searchsorted(named[0], found, sorter=order)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), sig)), pa.array(found), pa.array(named[1][at])],
                    ["sig", "node", "component"],
                )

    return dealt.mapInArrow(run, "sig long, node long, component long")


def apart_signatures(rows: DataFrame) -> DataFrame:
    """The rows of one signature of each set of classes: others of the same classes tell the same pairs.

    Without this a pair of long texts would be dealt for each of its many signatures.
    """
    whole = rows.groupBy("sig").agg(
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
        F.count(F.lit(1)).alias("many"),
    )
    kept = whole.groupBy("one", "two", "many").agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(kept, "sig", "left_semi")


def crossing_links(
    rows: DataFrame, classes: DataFrame, held: DataFrame, percent: int
) -> DataFrame:
    """a, b: links between components, among classes of one signature.

    All that may link are verified, but those that links of the same block joined
    already, and those that met at a smaller signature. So a block gives out fewer
    rows than it has components.
    """
    size = BLOCK * LIGHT
    every = rows.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    bits = classes.select("node", "bits")
    known = cut_lineage(held.join(bits, "node").join(every, "node"))
    counts = known.select("node", "n")
    weight = F.least(F.greatest("n", F.lit(LIGHT)), F.lit(size))
    placed = in_blocks(rows.join(counts, "node"), weight, size).drop("n")
    dealt = placed.join(known, "node").select(
        "sig", "block", "place", "node", "component", "n", "bits", "shingles", "sigs"
    )
    dealt = dealt.repartition("sig", "block").sortWithinPartitions("sig", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Verifying(0)
        for sig, begins, inside, part in block_parts(batches, size):
            if begins:
                block = Verifying(sig)
            node, component, n = (part.column(i).to_numpy() for i in (3, 4, 5))
            shingles, sigs = (
                [part.column(i)[k].values.to_numpy() for k in range(len(part))] for i in (7, 8)
            )
            maps = part.column(6).to_pylist()
            links = block.links(node, component, n, maps, shingles, sigs, inside, percent)
            if links:
                pair = np.sort(np.array(links, dtype=np.int64), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"]
                )

    return dealt.mapInArrow(run, "a long, b long").distinct()


def folded(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps at a length of so many words, which none is shorter than."""
    rows = np.zeros((len(maps), words), dtype=np.uint64)
    for i, bits in enumerate(maps):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, words), axis=0)
    return rows


class Held:
    """The classes of a block, met by those that follow."""

    def __init__(self):
        self.node = self.component = self.n = np.zeros(0, np.int64)
        self.maps: list[bytes] = []

    def met(
        self, node, component, n, maps, inside, percent
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those inside the block are held; then places of held and of new classes that may link."""
        before = len(self.node)
        count = int(inside.sum())  # rows come in order, so these are the first
        self.node = np.concatenate((self.node, node[:count]))
        self.component = np.concatenate((self.component, component[:count]))
        self.n = np.concatenate((self.n, n[:count]))
        self.maps += maps[:count]
        words = min(map(len, [*self.maps, *maps])) // 8
        ours = folded(self.maps, words)
        step = max(1, 4_000_000 // (max(len(ours), 1) * words))
        for at in range(0, len(node), step):
            new = slice(at, at + step)
            theirs = folded(maps[at : at + step], words)
            apart = np.bitwise_count(ours[:, None, :] ^ theirs[None, :, :]).sum(axis=2)
            near = apart <= differing(self.n[:, None], n[None, new], percent)
            near &= self.component[:, None] != component[None, new]
            # Of two classes in the block, the one before is met by the one after.
            order = np.arange(at, min(at + step, len(node))) + before
            near &= np.arange(len(ours))[:, None] < order[None, :]
            i, j = np.nonzero(near)
            yield i, at + j


def sharing(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lists number i and j have a value in common, for each pair."""
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    # Values of one list only tell nothing.
    wanted = np.cumsum(times > 1) - 1
    several = times[place] > 1
    own, place = own[several], wanted[place[several]]
    found = np.zeros(len(i), dtype=bool)
    for low in range(0, int((times > 1).sum()), 4096):
        some = (place >= low) & (place < low + 4096)
        has = np.zeros((len(lists), 4096), dtype=bool)
        has[own[some], place[some] - low] = True
        words = np.packbits(has, axis=1).view(np.uint64)
        for at in range(0, len(i), 50_000):
            cut = slice(at, at + 50_000)
            found[cut] |= (words[i[cut]] & words[j[cut]]).any(axis=1)
    return found


class Verifying(Held):
    """The classes of a block with their shingles, joined as links are found."""

    def __init__(self, sig: int):
        super().__init__()
        self.sig = sig
        self.shingles: list[np.ndarray] = []
        self.lower: list[np.ndarray] = []
        self.joined: dict[int, int] = {}

    def root(self, component: int) -> int:
        last = component
        while last in self.joined:
            last = self.joined[last]
        while component != last:
            self.joined[component], component = last, self.joined[component]
        return last

    def roots(self, components: np.ndarray) -> np.ndarray:
        return np.array([self.root(c) for c in components.tolist()]) if self.joined else components

    def links(self, node, component, n, maps, shingles, sigs, inside, percent) -> list[tuple[int, int]]:
        """Links of held and new classes that join components."""
        found = []
        count = int(inside.sum())
        lower = [s[: np.searchsorted(s, self.sig)] for s in sigs]
        self.shingles += shingles[:count]
        self.lower += lower[:count]
        for i, j in self.met(node, component, n, maps, inside, percent):
            if len(i):
                apart = self.roots(self.component)[i] != self.roots(component)[j]
                i, j = i[apart], j[apart]
            if len(i):
                first = ~sharing([*self.lower, *lower], i, j + len(self.lower))
                i, j = i[first], j[first]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                one, two = self.root(int(self.component[x])), self.root(int(component[y]))
                if one == two:
                    continue
                both = len(np.intersect1d(self.shingles[x], shingles[y], assume_unique=True))
                if both * 100 >= (int(self.n[x]) + int(n[y]) - both) * percent:
                    self.joined[one] = two
                    found.append((int(self.node[x]), int(node[y])))
        return found


def linked(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: a row per document; see the module.

    component_id is the smallest doc_id that links lead to.
    """
    return grouped(documents, percent).drop("root")


def grouped(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Columns of `linked`, and root: a number of the component, null for empty sets.

    Equal sets that no row with an id has are a component of their own.
    """
    told = cut_lineage(set_rows(documents))
    common = common_shingles(told)
    rows = told.where("block is null")
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    every = (
        rows.where("key is not null")
        .groupBy("key", "key2", "n_shingles")
        .agg(F.min(with_id).alias("least"), F.first("bits").alias("bits"))
        .select(
            "key",
            "key2",
            "n_shingles",
            "bits",
            F.col("least.doc_id").alias("rep"),
            F.col("least.text_hash").alias("rep_text"),
            F.monotonically_increasing_id().alias("node"),
        )
    )
    # Written out, so that the numbers stay as they are.
    every = cut_lineage(every)
    classes = every.where("rep is not null")
    bands = classes.groupBy(band_column(F.col("n_shingles")).alias("band")).count().collect()
    there = {r["band"]: r["count"] for r in bands}
    windows = {n: allocated(n, there[n] + there.get(n + 1, 0), percent) for n in there}
    merged = components_of(documents, classes, windows, common, percent)
    known = cut_lineage(merged.join(classes.select("node", "rep"), "node"))
    smallest = cut_lineage(known.groupBy("component").agg(F.min("rep").alias("smallest")))
    merged = known.join(smallest, "component").select("node", "component", "smallest")
    named = every.join(merged, "node", "left").select(
        F.col("key").alias("_key"),
        F.col("key2").alias("_key2"),
        F.coalesce("smallest", "rep").alias("component_id"),
        F.coalesce("component", "node").alias("root"),
    )
    same = (rows["key"] == named["_key"]) & (rows["key2"] == named["_key2"])
    # A null id has no other component than that of equal sets with an id.
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    return rows.join(named, same, "left").select(
        "doc_id", "text_hash", "n_shingles", own, "root"
    )


def representatives(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id; columns as they are.

    Documents without words stay, all of them. Of rows with the same id in one
    component, one stays; rows of one id in several components stay in each. Of rows
    without an id, every set stays that no row with an id has, once.
    """
    found = grouped(documents, percent)
    alone = F.col("n_shingles") == 0
    first = F.col("component_id").eqNullSafe(F.col("doc_id"))
    digest, place, *own = fresh(documents, "_digest", "_place", "_doc", "_alone", "_text")
    its_doc, its_alone, its_text = own
    # Of one id without words every row stays, whatever its text.
    empty = found.where(alone).select("doc_id", "text_hash", F.lit(True).alias("alone")).distinct()
    kept = (
        found.where(~alone & first)
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
        .select("least.*", F.lit(False).alias("alone"))
    )
    kept = kept.unionByName(empty).select(
        F.col("doc_id").alias(its_doc),
        F.col("alone").alias(its_alone),
        F.col("text_hash").alias(its_text),
    )
    rows = documents.withColumn(digest, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(its_doc)) & (F.col(digest) == F.col(its_text))
    # Fully repeated rows are one document.
    alike = Window.partitionBy("doc_id", digest).orderBy(its_alone)
    joined = rows.join(kept, same).withColumn(place, F.row_number().over(alike))
    return joined.where(F.col(its_alone) | (F.col(place) == 1)).select(
        *[F.col(f"`{c}`") for c in documents.columns]
    )
