"""How the sources of a language differ in the words they use.

Rows of a matrix are the sources of one language, columns the terms it keeps, cells how
often a source says a term. The matrix is stored as k-squared quadtrees: a square is
cut into four until it is a cell, and a quadrant of zeros is not stored at all. Two
sources are compared by going down their trees together. Where both have a quadrant of
zeros, every pair of sources and every column in it has the same price, which is
counted and not visited; where either has a cell, that cell is priced by itself.

A source gives a term p = 1 + floor(SCALE * (count + 1) / (N + V)), where N sums its counts
of kept terms and V is how many terms the language keeps; the language's own q comes from
its sums. f = floor((p - q)^2 / q), all in whole numbers.

* Null text, lang and source are empty strings. Terms are runs of ASCII letters and of
  characters beyond ASCII; A to Z are lower-cased. A language keeps the terms that at
  least `least_docs` of its documents have.
* Every (lang, source) that occurs is a group, also without any term; a language that
  keeps no term prices its pairs 0. A language with one source has no pairs.
* Repeated rows count each, as documents of their own. Ids and other columns are ignored.
  Texts of any length are read whole. An empty table gives an empty result.
* Ties in rank go to the item that comes first by UTF-8 bytes.
* Columns are dealt into blocks by a hash of the term, sources into tiles; a task holds the
  cells of one block for two tiles. Pieces of one pair are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage
from assay.llm.words import ALPHANUMERIC, Words, chunks, encoded

SCALE = 1_000_000_000
LEAST_DOCS = 3
TERM_RANKS = 200
#: Columns of a block, by about how many cells two tiles of it have.
CELLS = 1 << 20
#: Sources of a tile.
TILE = 256
#: Pairs of quadrants held at a time while two trees are gone down.
FRONTIER = 1 << 18

#: ASCII letters, and every byte of a character beyond ASCII.
LETTERS = ALPHANUMERIC.copy()
LETTERS[0x30:0x3A] = False


# Counting


def _terms(words: Words) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones, and those."""
    lengths = words.ends - words.starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    data = np.ascontiguousarray(words.data[words.word])
    said = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
    known = said.dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary


def _pairs_counted(first: np.ndarray, second: np.ndarray, size: int):
    """Distinct pairs of numbers, the second below `size`, and how often each is there."""
    keys, n = np.unique(first * size + second, return_counts=True)
    return keys // size, keys % size, n


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in chunks(batch.column(0)):
                part = batch.slice(first, last - first)
                words = Words(encoded(part.column(0)), LETTERS)
                if not len(words.starts):
                    continue
                code, terms = _terms(words)
                langs, sources = part.column(1).dictionary_encode(), part.column(2).dictionary_encode()
                both = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary)
                names, number = np.unique(both + sources.indices.to_numpy(), return_inverse=True)
                row, own, _ = _pairs_counted(words.row, code, len(terms))
                _, _, docs = _pairs_counted(number[row], own, len(terms))
                groups, said, n = _pairs_counted(number[words.row], code, len(terms))
                lang, source = np.divmod(names[groups], len(sources.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(lang)),
                        sources.dictionary.take(pa.array(source)),
                        terms.take(pa.array(said)),
                        pa.array(n),
                        pa.array(docs),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    rows = _groups_of(documents).select("text", "lang", "source")
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups_of(documents: DataFrame) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    return documents.select(known("text"), known("lang"), known("source"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n, sources: a row per kept term with its counts by source, none twice."""
    by_source = F.collect_list(F.struct("source", "n")).alias("sources")  # one per source
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), by_source
    )
    return terms.where(F.col("docs") >= least_docs).drop("docs")


# Prices


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) without a product that could overflow."""
    left = np.broadcast_to(count + 1, np.broadcast(count, total).shape).copy()
    whole = np.zeros_like(left)
    for _ in range(3):
        left *= 1000
        whole = whole * 1000 + left // total
        left %= total
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def probability_column(count: Column, total: Column) -> Column:
    whole, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        raised = left * 1000
        whole, left = whole * 1000 + F.call_function("div", raised, total), raised % total
    return whole + 1


# Trees


class Quadtree:
    """Cells (row, column) of a square of 2**levels, as bits of four children per nonzero node.

    `bits` has, by level, four flags for each node of the level, in Morton order: the
    children with a cell in them. A child's place on its own level is the number of flags before
    it. `values` are the cells in the order of the last level's flags.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, levels: int):
        self.levels = levels
        code = np.zeros(len(rows), dtype=np.int64)
        for level in range(levels - 1, -1, -1):
            code = code * 4 + ((rows >> level) & 1) * 2 + ((columns >> level) & 1)
        order = np.argsort(code, kind="stable")
        code, self.values = code[order], values[order]
        self.bits, self.before = [], []
        nodes = np.zeros(1 if len(code) else 0, dtype=np.int64)
        for level in range(levels - 1, -1, -1):
            children = np.unique(code >> (2 * level))
            flags = np.zeros(4 * len(nodes), dtype=bool)
            flags[4 * np.searchsorted(nodes, children >> 2) + (children & 3)] = True
            self.bits.append(flags)
            self.before.append(np.cumsum(flags) - flags)
            nodes = children

    def children(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Places of children on the next level; -1 for quadrants of zeros, and of those."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        there = (node >= 0) & self.bits[level][at]
        return np.where(there, self.before[level][at], -1)

    def cells(self, node: np.ndarray) -> np.ndarray:
        """Values of places on the last level, 0 for zeros."""
        if not len(self.values):
            return np.zeros(len(node), dtype=np.int64)
        return np.where(node >= 0, self.values[np.maximum(node, 0)], 0)


#: Quadrants of a pair: the half of the rows of the one, of the other, and of the columns.
_HALVES = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], dtype=np.int64)


def joint_prices(
    one: Quadtree, other: Quadtree, totals: np.ndarray, other_totals: np.ndarray, width: int
) -> np.ndarray:
    """Sums of f over `width` columns for every row of `one` (p) and of `other` (q).

    `totals` are N + V of the rows.
    """
    many, against = len(totals), len(other_totals)
    summed = np.zeros(many * against, dtype=np.int64)
    levels = one.levels
    # Columns of zeros by quadrant of row pairs; a quadrant of a level covers 2**(levels - level) rows.
    zeros = [np.zeros((-(-many >> left), -(-against >> left)), dtype=np.int64) for left in range(levels, -1, -1)]
    start = np.zeros(1, dtype=np.int64)
    first = np.full(1, 0 if len(one.values) else -1)
    second = np.full(1, 0 if len(other.values) else -1)
    if not len(one.values) and not len(other.values):
        zeros[0][0, 0] += width
        stack = []
    else:
        stack = [(0, first, second, start, start, start)]
    while stack:
        level, a, b, rows, against_rows, columns = stack.pop()
        if len(a) * 8 > FRONTIER and len(a) > 1:
            half = len(a) // 2
            for cut in (slice(None, half), slice(half, None)):
                stack.append((level, *[x[cut] for x in (a, b, rows, against_rows, columns)]))
            continue
        if level == levels:
            p = probability(one.cells(a), totals[rows])
            q = probability(other.cells(b), other_totals[against_rows])
            np.add.at(summed, rows * against + against_rows, price(p, q))
            continue
        left = levels - level - 1
        halves = np.tile(_HALVES, (len(a), 1))
        a, b, rows, against_rows, columns = (np.repeat(x, 8) for x in (a, b, rows, against_rows, columns))
        a = one.children(level, a, 2 * halves[:, 0] + halves[:, 2])
        b = other.children(level, b, 2 * halves[:, 1] + halves[:, 2])
        rows, against_rows, columns = 2 * rows + halves[:, 0], 2 * against_rows + halves[:, 1], 2 * columns + halves[:, 2]
        inside = (rows << left < many) & (against_rows << left < against) & (columns << left < width)
        empty = inside & (a < 0) & (b < 0)
        size = np.minimum(width - (columns[empty] << left), 1 << left)
        np.add.at(zeros[level + 1], (rows[empty], against_rows[empty]), size)
        on = inside & ~empty
        if on.any():
            stack.append((level + 1, *[x[on] for x in (a, b, rows, against_rows, columns)]))
    nothing = np.zeros(1, dtype=np.int64)
    p, q = probability(nothing, totals), probability(nothing, other_totals)
    at, at_other = np.arange(many), np.arange(against)
    priced = summed.reshape(many, against)
    for level, held in enumerate(zeros):
        left = levels - level
        priced = priced + held[at >> left][:, at_other >> left] * price(p[:, None], q[None, :])
    return priced


# The audit


def group_totals(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms: N of every group that occurs, and V of its language."""
    groups = _groups_of(documents).select("lang", "source").distinct()
    said = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    return groups.join(said, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")]
    )


def pair_prices(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: what every source of a language costs coded as every other one."""
    of_lang = groups.groupBy("lang").agg(
        F.max("terms").alias("terms"),
        F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"),
    )
    tiles = F.ceil(F.size("members") / TILE)
    cells = F.least(F.size("members"), F.lit(TILE))
    of_lang = cut_lineage(
        of_lang.withColumns(
            {
                "tiles": tiles.cast("int"),
                "blocks": F.greatest(F.ceil(F.col("terms") * cells * cells / CELLS), F.lit(1)),
            }
        )
    )
    dealt = kept.join(of_lang.select("lang", "blocks"), "lang")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    blocks = dealt.groupBy("lang", block).agg(F.collect_list("sources").alias("columns"))
    # A language without kept terms has pairs, and so one empty block.
    bare = of_lang.where("terms = 0").select(
        "lang", F.lit(0).cast("long").alias("block"), F.array().cast(blocks.schema["columns"].dataType).alias("columns")
    )
    last_tile = F.col("tiles") * F.col("tiles") - 1
    pairs = (
        blocks.unionByName(bare)
        .join(of_lang, "lang")
        .select("lang", "terms", "members", "columns", F.explode(F.sequence(F.lit(0), last_tile)).alias("tile"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield from _priced(batch.slice(row, 1))

    parts = pairs.mapInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _priced(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of two tiles of sources over the columns of one block."""
    members = row.column("members").flatten()
    names, totals = members.field("source"), members.field("total").to_numpy()
    tiles, tile = -(-len(names) // TILE), row.column("tile")[0].as_py()
    first, second = (tile // tiles) * TILE, (tile % tiles) * TILE
    columns = row.column("columns").flatten()
    width = len(columns)
    cells = columns.flatten()
    many = np.asarray(pc.list_value_length(columns)).astype(np.int64)
    column = np.repeat(np.arange(width), many)
    source = pc.index_in(cells.field("source"), value_set=names).to_numpy(zero_copy_only=False)
    n = cells.field("n").to_numpy()
    own, against = names[first : first + TILE], names[second : second + TILE]
    levels = max(width - 1, len(own) - 1, len(against) - 1, 1).bit_length()

    def tree(begin: int, size: int) -> Quadtree:
        inside = (source >= begin) & (source < begin + size)
        return Quadtree((source[inside] - begin).astype(np.int64), column[inside], n[inside], levels)

    all_terms = row.column("terms")[0].as_py()
    with_terms = np.maximum(totals + all_terms, 1)  # at least 1 where nothing is priced
    one, other = tree(first, len(own)), tree(second, len(against))
    found = joint_prices(
        one, other, with_terms[first : first + TILE], with_terms[second : second + TILE], width
    )
    a, b = (x.ravel() for x in np.indices(found.shape))
    apart = a + first != b + second
    a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays(
        [
            pa.repeat(row.column("lang")[0], len(a)),
            own.take(pa.array(a)),
            against.take(pa.array(b)),
            pa.array(found[a, b]),
        ],
        ["lang", "source", "item", "value"],
    )


def term_prices(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a source says more often than its language does."""
    said = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("sources"))
    joined = said.join(groups, ["lang", "source"])
    p = probability_column(F.col("n"), F.col("total") + F.col("terms"))
    q = probability_column(F.col("lang_n"), F.col("lang_total") + F.col("terms"))
    priced = joined.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    gap = F.col("p") - F.col("q")
    value = F.call_function("div", gap * gap, F.col("q"))
    return priced.where("p > q").select("lang", "source", "item", value.alias("value"))


def audited(documents: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: of all pairs, and of each group's dearest terms."""
    kept = cut_lineage(kept_terms(term_counts(documents), least_docs))
    groups = cut_lineage(group_totals(documents, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)}).select(*columns)

    terms = ranked(term_prices(kept, groups), "term").where(F.col("rank") <= term_ranks)
    return ranked(pair_prices(kept, groups), "pair").unionByName(terms)
