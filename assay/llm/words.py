"""Words and shingles of many texts at once, as hashes in numpy arrays.

Runs inside tasks, over the batches that Spark hands out. Texts are taken in
chunks of about a megabyte, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SHINGLE = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but ASCII white space, U+0020 and U+0009 to U+000D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII digits and letters, and every byte of a character beyond ASCII.
ALPHANUMERIC = np.ones(256, dtype=bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALPHANUMERIC[_first : _last + 1] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mixed(np.arange(256, dtype=np.uint64))
_PLACES = mixed(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | np.uint64(1)
STEPS = mixed(np.arange(9000, 9000 + 64, dtype=np.uint64)) | np.uint64(1)


def _places(longest: int) -> np.ndarray:
    if longest <= len(_PLACES):
        return _PLACES
    return mixed(np.arange(1000, 1000 + longest, dtype=np.uint64)) | np.uint64(1)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    first, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield first, row
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


class Words:
    """The words of a few texts: `starts` and `ends` in `data`, `row` of each, by text in order.

    `data` is lower-cased (A to Z), `counts` has the words of each text; null
    texts have none.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.data = LOWER[self.raw]
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        n = len(self.data)
        word = inside[self.raw]
        breaks = np.zeros(n + 1, dtype=bool)
        breaks[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | breaks[:n]))
        self.ends = np.flatnonzero(word & (~after | breaks[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=len(texts)).astype(np.int64)
        self.word = word

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, dtype=np.uint64)
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        parts = BYTE_CODE[self.data[self.word]] * _places(int(lengths.max()))[place]
        return mixed(np.add.reduceat(parts, firsts) + lengths.astype(np.uint64))


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size` consecutive words, repeats included, and how many each text has.

    A text with fewer words, but not none, has one: its whole sequence.
    """
    hashes, counts = words.hashes(), words.counts
    firsts = np.cumsum(counts) - counts
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(many.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), many
    starts = np.cumsum(many) - many
    at = np.arange(total) - np.repeat(starts, many) + np.repeat(firsts, many)
    length = np.repeat(np.minimum(counts, size), many)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    summed = length.astype(np.uint64)
    for step in range(size):
        part = padded[at + step] * STEPS[step]
        summed = summed + (part if total and length.min() > step else np.where(length > step, part, 0))
    return mixed(summed), many


def sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, and how many each has."""
    found, many = shingles(words, size)
    bounds = np.concatenate(([0], np.cumsum(many)))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first > 1:
            found[first:last].sort()
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = found[1:] != found[:-1]
    inner = bounds[:-1][many > 0]
    keep[inner] = True
    row = np.repeat(np.arange(len(many)), many)[keep]
    return found[keep], np.bincount(row, minlength=len(many)).astype(np.int64)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t if t is not None else b"" for t in texts.cast(pa.binary()).to_pylist()]


