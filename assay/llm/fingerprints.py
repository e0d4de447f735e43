"""One-permutation MinHash fingerprints of documents.

The 64-bit hash of each word shingle is used once: its top bits choose one of 512
bins, the rest is its value, and a bin keeps its smallest. An empty bin takes
the value of a full one by optimal densification: it tries bins in an order
of its own, alike for all texts, until one is full. Of every bin's value, mixed with the
number of the bin, four low bits are kept, packed as 512 hexadecimal digits: a value
that fills many bins has bits of its own in each, so that bins of unlike texts agree by
chance once in 16 each, however few shingles there are. `likenesses` takes that off again.

The standard error of a likeness of texts with many more shingles than bins is 0.024 at most.
Of short texts the few shingles that fill all bins are weighed by the bins that they happen
to fill, so it grows to that of a sample: about 0.5 / sqrt(shingles in either text), while
disjoint sets stay within 0.06 and equal ones are 1.

* Words are split at ASCII white space and A to Z lower-cased; shingles take five
  words, a shorter text is one shingle.
* Null, empty and blank texts have the empty string as fingerprint: like each other
  (1.0) and unlike any other (0.0).
* Equal texts have equal fingerprints. Repeated ids are rows of their own, in order
  of their texts; null ids come first. An empty table gives an empty result.
* Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import partitions
from assay.llm.words import CHUNK_BYTES, NOT_BLANK, Words, chunks, encoded, mixed, shingles

BINS, BITS = 512, 4
EMPTY = np.uint64(2**64 - 1)


def densified(table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of rows that have a full one."""
    full = table != EMPTY
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        tried = mixed(bins.astype(np.uint64) + np.uint64(attempt * BINS))
        source = (tried >> np.uint64(32)) % np.uint64(BINS)
        source = source.astype(np.int64)
        found = full[rows, source]
        table[rows[found], bins[found]] = table[rows[found], source[found]]
        rows, bins = rows[~found], bins[~found]
    return table


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of bins for each text, low bits only; 255 throughout for one without words."""
    found, many = shingles(Words(texts, NOT_BLANK))
    table = np.full(len(texts) * BINS, EMPTY, dtype=np.uint64)
    width = np.uint64(64 - BINS.bit_length() + 1)
    row = np.repeat(np.arange(len(texts)), many)
    at = row * BINS + (found >> width).astype(np.int64)
    np.minimum.at(table, at, found & ((np.uint64(1) << width) - np.uint64(1)))
    table = densified(table.reshape(len(texts), BINS))
    own = mixed(np.arange(BINS, dtype=np.uint64))
    bits = (mixed(table ^ own) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits[many == 0] = 255
    return bits


def packed(bits: np.ndarray) -> list[str]:
    """Hexadecimal digits, one for each bin; empty for a text without words."""
    halves = ((bits[:, 0::2] << 4) | (bits[:, 1::2] & 15)).astype(np.uint8)
    return ["" if b[0] == 255 else h.tobytes().hex() for b, h in zip(bits, halves, strict=True)]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches row by row, corrected for chance."""
    chance = 1 / 2**BITS
    alike = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.clip(alike, 0.0, 1.0)


def fingerprinted(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in chunks(texts):
                part = texts.slice(first, last - first)
                prints = pa.array(packed(sketches(encoded(part))), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), prints], ["doc_id", "fingerprint"]
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, extra: partitions in order of doc_id, each ending with the next one's first rows.

    Rows with `extra` are there to be looked at only. The last partition is followed
    by the first. What the driver gets is a number of ids per partition.
    """
    parts = partitions(documents.sparkSession)
    ids = documents.select("doc_id").where("doc_id is not null")
    shares = [i / parts for i in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)

    @F.pandas_udf("long")
    def part_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.isna()
        at = np.searchsorted(cuts, doc_id.fillna(0).astype(np.int64), side="left")
        return pd.Series(np.where(known, 0, at))

    heads = (
        documents.select("doc_id", part_of("doc_id").alias("part"))
        .groupBy("part")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.max(F.col("doc_id").isNull()).alias("nulls"),
        )
        .orderBy("part")
        .collect()
    )
    #: The partition before the one that a first id opens.
    before = {
        (None if head["nulls"] else head["doc_id"]): heads[i - 1]["part"]
        for i, head in enumerate(heads)
    }

    @F.pandas_udf("array<long>")
    def parts_of(doc_id: pd.Series) -> pd.Series:
        known = ~doc_id.isna()
        whole = doc_id.fillna(0).astype(np.int64)
        at = np.where(known, np.searchsorted(cuts, whole, side="left"), 0)
        keys = [d if k else None for d, k in zip(whole.tolist(), known.tolist(), strict=True)]
        return pd.Series(
            [[p, before[d]] if d in before else [p] for d, p in zip(keys, at.tolist(), strict=True)]
        )

    dealt = documents.select("doc_id", "text", parts_of("doc_id").alias("parts")).select(
        "doc_id", "text", F.posexplode("parts").alias("extra", "part")
    )
    return (
        dealt.repartitionById(parts, F.col("part").cast("int"))
        .sortWithinPartitions("extra", F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text", "extra")
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(documents: DataFrame) -> DataFrame:
    """Every document beside its edited text and the next document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts = batch.column(1)
            ids, extras = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last in chunks(texts):
                part = texts.slice(first, last - first).to_pylist()
                yield from zip(ids[first:last], part, extras[first:last], strict=True)

    def done(held: list[tuple[int, str]], following: str) -> pa.RecordBatch:
        ids, texts = [d for d, _ in held], [t for _, t in held]
        edited = [edited_text(t, n) for t, n in zip(texts, [*texts[1:], following], strict=True)]
        own = sketches([t.encode() for t in [*texts, following]])
        coded = [t.encode() for t in edited]
        other = sketches(coded)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in coded], pa.string()),
                pa.array(packed(own[:-1]), pa.string()),
                pa.array(packed(other), pa.string()),
                pa.array(likenesses(own[:-1], other), pa.float64()),
                pa.array(likenesses(own[:-1], own[1:]), pa.float64()),
            ],
            [c.split()[0] for c in EDITED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size = 0
        for doc_id, text, extra in rows(batches):
            text = text or ""
            if held and (extra or size > CHUNK_BYTES):
                yield done(held, text)
                held, size = [], 0
            if extra:
                break
            held.append((doc_id, text))
            size += len(text)
        for _ in batches:
            pass  # what is left are further rows of the first id

    return with_next(documents.select("doc_id", "text")).mapInArrow(run, EDITED)
