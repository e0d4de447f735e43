"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of the items; streaming a document's words
through it gives, at each word, the longest run that ends there and occurs in an
item. Where that is at least `window` words (or all of a shorter item), the last
`window` words are hit. Hit spans are removed, and documents with too large a share
of hit words dropped.

Words are lower-cased runs of ASCII digits and letters and of anything beyond ASCII.
A match of two words needs both as neighbours in an item, so only stretches of such
neighbours are streamed; elsewhere the automaton could not get as far.

* A null, empty or wordless text has no words and no hits. Items without words are
  ignored; equal items count each. Repeated documents are judged alike.
* Texts of any length are read whole. Empty documents or items give no hits.
* Items are taken in shards of `SHARD_WORDS` words, each with an automaton of its
  own through which all documents go, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import fresh
from assay.llm.words import ALPHANUMERIC, Words, chunks, encoded, mixed

WINDOW = 10
SHARD_WORDS = 50_000
COVERAGE = 0.5
#: What columns found are called, where documents have none of these.
ADDED = ("_n_words", "_spans", "_items")


class SuffixAutomaton:
    """All runs of words of several items; separators that no text has keep items apart."""

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Items by the state that holds a run of `window` words.
        self.held: dict[int, set[int]] = {}
        #: Items that are shorter, by the state that holds all their words.
        self.whole: dict[tuple[int, int], set[int]] = {}
        last, ends = 0, []
        for number, (_name, words) in enumerate(items):
            for word in words:
                last = self._append(last, self.ids.setdefault(word, len(self.ids)))
                ends.append((last, number))
            last = self._append(last, -1 - number)
        for number, (_name, words) in enumerate(items):
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.steps[state][self.ids[word]]
                self.whole.setdefault((state, len(words)), set()).add(number)
        self.short = sorted({n for _, n in self.whole})
        for state, number in ends:
            if self.length[state] >= window:
                self.held.setdefault(self.up(state, window), set()).add(number)

    def _append(self, last: int, word: int) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.steps[at][word]
            if self.length[to] != self.length[at] + 1:
                copy = self._state(self.length[at] + 1, dict(self.steps[to]), self.link[to])
                while at >= 0 and self.steps[at].get(word) == to:
                    self.steps[at][word] = copy
                    at = self.link[at]
                self.link[to] = to = copy
            self.link[new] = to
        return new

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.steps.append(steps)
        self.link.append(link)
        return len(self.length) - 1

    def up(self, state: int, length: int) -> int:
        """The state of the last `length` words of a longer run."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(place after the last word, words, items) of every window that occurs."""
        state = matched = 0
        for at, word in enumerate(words, 1):
            number = self.ids.get(word)
            while state and (number is None or number not in self.steps[state]):
                state = self.link[state]
                matched = self.length[state]
            if number is None or number not in self.steps[state]:
                continue
            state = self.steps[state][number]
            matched += 1
            for n in self.short:
                if n <= matched and (found := self.whole.get((self.up(state, n), n))):
                    yield at, n, found
            if matched >= self.window:
                yield at, self.window, self.held[self.up(state, self.window)]


class Detector:
    """An automaton with the neighbours that tell where it need not be run."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        texts = [text for _, text in items]
        words = Words(texts, ALPHANUMERIC)
        hashes = words.hashes()
        split = np.split(np.arange(len(hashes)), np.cumsum(words.counts)[:-1]) if texts else []
        data = words.data.tobytes()
        held = [
            (name, [data[words.starts[i] : words.ends[i]] for i in at])
            for (name, _), at in zip(items, split, strict=True)
        ]
        self.automaton = SuffixAutomaton(held, window)
        lengths = [min(window, len(w)) for _, w in held if w]
        self.least = min(lengths, default=0)
        inner = words.row[1:] == words.row[:-1]
        self.known = np.unique(hashes)
        self.pairs = np.unique(joined(hashes)[inner])

    def stretches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) words of the stretches that may hold a window."""
        hashes = words.hashes()
        if self.least == 0 or not len(hashes):
            return np.zeros(0, int), np.zeros(0, int)
        if self.least == 1:
            good = np.isin(hashes, self.known)
            near = good[1:] & good[:-1] & (words.row[1:] == words.row[:-1])
            opens = np.flatnonzero(good & ~np.concatenate(([False], near)))
            ends = np.flatnonzero(good & ~np.concatenate((near, [False]))) + 1
            return opens, ends
        near = found_in(self.pairs, joined(hashes)) & (words.row[1:] == words.row[:-1])
        opens = np.flatnonzero(near & ~np.concatenate(([False], near[:-1])))
        ends = np.flatnonzero(near & ~np.concatenate((near[1:], [False]))) + 2
        enough = ends - opens >= self.least
        return opens[enough], ends[enough]

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the names of the items found by text."""
        change = np.zeros(len(words.starts) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        names = self.automaton.names
        for first, last in zip(*(x.tolist() for x in self.stretches(words)), strict=True):
            run = words.data[words.starts[first] : words.ends[last - 1]].tobytes()
            base = words.starts[first]
            own = [
                run[a - base : b - base]
                for a, b in zip(words.starts[first:last], words.ends[first:last], strict=True)
            ]
            for at, n, found in self.automaton.stream(own):
                change[first + at - n] += 1
                change[first + at] -= 1
                row = int(words.row[first])
                items.setdefault(row, set()).update(names[i] for i in found)
        return np.cumsum(change[:-1]) > 0, items


def joined(hashes: np.ndarray) -> np.ndarray:
    """A hash for each pair of neighbours."""
    return mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def found_in(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(wanted), dtype=bool)
    # A table of bits sorts out nearly all before the search.
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(known >> np.uint64(44)).astype(np.int64)] = True
    out = bits[(wanted >> np.uint64(44)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, wanted[maybe]), len(known) - 1)
    out[maybe] = known[at] == wanted[maybe]
    return out


def shards(items: DataFrame, item: str, text: str, words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in lists of about so many words, one list in memory at a time."""
    name = F.coalesce(F.col(item).cast("string"), F.lit(""))
    rows = items.select(name, text).where(F.col(text).isNotNull())
    held, size = [], 0
    for name, said in rows.toLocalIterator():
        held.append((name, said.encode()))
        size += len(said.split()) + 1
        if size >= words:
            yield held
            held, size = [], 0
    if held:
        yield held


def matched(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    item: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """The documents with three more columns: n_words, spans and items, see ADDED.

    Spans are places of words hit, the last excluded, in order and apart from each
    other; items are the identifiers found, as strings, each once and sorted, a null
    one empty.
    """
    n_words, spans, found = fresh(documents, *ADDED)
    out = documents.withColumns(
        {
            n_words: F.lit(0).cast("long"),
            spans: F.expr("cast(array() as array<array<long>>)"),
            found: F.expr("cast(array() as array<string>)"),
        }
    )
    context = documents.sparkSession.sparkContext
    counted = False
    for shard in shards(items, item, text, shard_words):
        out = _matched(out, context.broadcast(shard), window)
        counted = True
    return out if counted else _matched(out, context.broadcast([]), window)


def _matched(documents: DataFrame, shared, window: int) -> DataFrame:
    names = documents.columns
    schema = documents.schema
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value, window)
        for batch in batches:
            for first, last in chunks(batch.column(at_text)):
                part = batch.slice(first, last - first)
                words = Words(encoded(part.column(at_text)), ALPHANUMERIC)
                hit, items = detector.hits(words)
                ends = np.cumsum(words.counts)
                spans = part.column(len(names) - 2).to_pylist()
                found = part.column(len(names) - 1).to_pylist()
                for row in items:
                    low, high = int(ends[row] - words.counts[row]), int(ends[row])
                    own = hit[low:high].copy()
                    for a, b in spans[row]:
                        own[a:b] = True
                    edge = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
                    pairs = (np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
                    spans[row] = [list(p) for p in zip(*(x.tolist() for x in pairs), strict=True)]
                    found[row] = sorted({*found[row], *items[row]})
                columns = [
                    *part.columns[:-3],
                    pa.array(words.counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(found, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(run, schema)


def decontaminated(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The documents, with hit spans taken out of their texts.

    Those of whose words more than `coverage` are hit go as a whole. A text that is
    not hit stays as it is. What stood before and after a span is joined by a line feed.
    """
    found = matched(documents, items, window, shard_words)
    schema = documents.schema
    names = documents.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names) + 1)
            if not sum(map(len, spans.to_pylist())):
                yield batch.select(names)
                continue
            for first, last in chunks(batch.column(at_text)):
                part = batch.slice(first, last - first)
                texts = part.column(at_text).to_pylist()
                counts = part.column(len(names)).to_pylist()
                kept = []
                for row, own in enumerate(part.column(len(names) + 1).to_pylist()):
                    hit = sum(b - a for a, b in own)
                    kept.append(not hit or hit <= coverage * counts[row])
                    if hit and kept[-1]:
                        texts[row] = cut(texts[row], own)
                columns = list(part.select(names).columns)
                columns[at_text] = pa.array(texts, columns[at_text].type)
                whole = pa.RecordBatch.from_arrays(columns, names)
                yield whole.filter(pa.array(kept, pa.bool_()))

    return found.mapInArrow(run, schema)


def cut(text: str, spans: Sequence[Sequence[int]]) -> str:
    """A text without the given spans of words."""
    raw = text.encode()
    words = Words([raw], ALPHANUMERIC)
    parts, at = [], 0
    for first, last in spans:
        parts.append(raw[at : words.starts[first]].rstrip())
        at = words.ends[last - 1]
    parts.append(raw[at:].lstrip())
    return b"\n".join(p for p in parts if p).decode()


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of `matched` rows."""
    hit = F.aggregate(
        "_spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + F.get(s, 1) - F.get(s, 0)
    )
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
