"""Language identification by multilingual mixtures.

A language is a distribution of letter trigrams, counted over every labelled text
given to `train`. A document is a mixture: each word comes from one of its
languages, with the likelihood of the word's trigrams. Expectation-maximisation
estimates the proportions, first over all languages, then over the 1, 2, ... most
present ones; of these sets the one with the best likelihood is taken, less
`penalty` times the logarithm of the number of words for each language more. Sets
grow, for a text, until no larger one can be better: there is no fixed maximum.

One more component, the background, stands for words of no learned language: half
of it is the trigrams of all texts, labelled or not, half is the same for every
trigram. It is weighed like a language, and its share counts as `und`. A text in
a language that nobody labelled, or in none, is mostly background. `Model.learned`
is the model without it, which gives every text with letters a learned language.

* A word is a run of letters of any script, in lower case. A null text, or one
  without letters, is `und` with score 0; so is every text if nothing was learned.
  Then, as nothing can tell the languages apart, `accepted` keeps all texts with letters.
* A row with null text teaches nothing, one with null lang or lang `und` (a label that
  says that the language is not known) only the background. Ties go to the language that
  comes first by code point, before the background. Repeated rows count as often
  as they are there.
* Texts of any length are read whole. An empty table gives an empty result.
* The model has 65,536 counts per language and as many for the background, whatever
  the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from assay.llm.common import fresh
from assay.llm.words import chunks

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 4.0
ROUNDS = 8
UNKNOWN = "und"
#: Of the background, in the trigrams that are equally likely.
UNIFORM = 0.5
#: Of the background, in a document that is still accepted. Of the learned languages a text
#: may have any number: passages in several are no reason to reject it.
MOST_UNKNOWN = 0.5

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _LETTERS:
        flags = (chr(i).isalpha() for i in range(0x110000))
        _LETTERS.append(np.fromiter(flags, dtype=bool, count=0x110000))
    return _LETTERS[0]


class LetterWords:
    """Trigram buckets of the letters of some texts, and where words and texts begin."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        points = "\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(points, dtype=np.uint32)
        inside = letters()[codes]
        kept = np.where(inside, codes, np.uint32(0))
        before = np.concatenate(([np.uint32(0)], kept[:-1]))
        after = np.concatenate((kept[1:], [np.uint32(0)]))
        at = np.flatnonzero(inside)
        hashed = (
            before[at] * np.uint32(0x9E3779B1)
            + kept[at] * np.uint32(0x85EBCA77)
            + after[at] * np.uint32(0xC2B2AE3D)
        )
        self.buckets = (hashed >> np.uint32(16)).astype(np.int64)
        opens = before[at] == 0
        self.firsts = np.flatnonzero(opens)  # of words, in `buckets`
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
        self.text_of_letter = np.searchsorted(ends, at, side="right")
        self.text = self.text_of_letter[self.firsts]
        self.counts = np.bincount(self.text, minlength=len(texts))


@dataclass(frozen=True)
class Model:
    """Log probabilities of trigram buckets: a row per language, then one for the background,
    if it has one."""

    languages: tuple[str, ...]
    logs: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Model:
        """Of counts by language, where `UNKNOWN` has those of texts without one."""
        names = tuple(sorted(n for n in counts if n != UNKNOWN))
        rows = [counts[n] + SMOOTHING for n in names]
        every = sum(counts.values(), np.full(BUCKETS, SMOOTHING))
        background = (1 - UNIFORM) * every / every.sum() + UNIFORM / BUCKETS
        logs = [np.log(r / r.sum()) for r in rows] + [np.log(background)]
        return cls(names, np.stack(logs).astype(np.float32))

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.languages, UNKNOWN)[: len(self.logs)]

    def learned(self) -> Model:
        """The model without its background."""
        return Model(self.languages, self.logs[: len(self.languages)])


def train(texts: DataFrame) -> Model:
    """The model of all rows (text, lang): counted in tasks, summed, small when it arrives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for first, last in chunks(texts):
                part = texts.slice(first, last - first).to_pylist()
                names = langs.slice(first, last - first).to_pylist()
                words = LetterWords(part)
                known = {n: i for i, n in enumerate(sorted(set(names)))}
                lang = np.array([known[n] for n in names])[words.text_of_letter]
                for name, number in known.items():
                    found = np.bincount(words.buckets[lang == number], minlength=BUCKETS)
                    held[name] = held[name] + found if name in held else found
                if len(held) > 64:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(found[at])],
                ["lang", "bucket", "n"],
            )

    label = F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")
    rows = texts.select("text", label).where("text is not null")
    parts = rows.mapInArrow(count, "lang string, bucket long, n long")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    names = summed.column("lang").to_pylist()
    bucket, n = (summed.column(c).to_numpy() for c in ("bucket", "n"))
    for name in sorted(set(names)):
        here = np.fromiter((x == name for x in names), bool, len(names))
        counts[name] = np.bincount(bucket[here], weights=n[here], minlength=BUCKETS)
    return Model.of(counts)


def mixture(
    likely: np.ndarray, opens: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by text, and log likelihoods, of words with the given log likelihoods.

    `likely` has a row per word and a column per language; a column may be -inf
    where a text's set does not have the language. Texts have a word at least.
    """
    top = likely.max(axis=1, keepdims=True)
    each = np.exp(likely - top)
    allowed = np.isfinite(likely[opens])
    shares = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        parts = each * np.repeat(shares, sizes, axis=0)
        parts /= parts.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(parts, opens, axis=0) / sizes[:, None].astype(np.float32)
    total = (each * np.repeat(shares, sizes, axis=0)).sum(axis=1)
    logs = np.log(np.maximum(total, np.float32(1e-30))) + top[:, 0]
    return shares, np.add.reduceat(logs.astype(np.float64), opens)


def most_likely(
    likely: np.ndarray, shares: np.ndarray, logs: np.ndarray, opens: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """By text, what no proportions over any of the columns exceed, as a log likelihood.

    The likelihood is concave in the proportions, so its slope at `shares`, where it
    is `logs`, bounds it everywhere.
    """
    each = np.exp(likely - likely.max(axis=1, keepdims=True))
    total = (each * np.repeat(shares, sizes, axis=0)).sum(axis=1, keepdims=True)
    slopes = np.add.reduceat((each / np.maximum(total, np.float32(1e-30))).astype(np.float64), opens)
    return logs + np.maximum(slopes.max(axis=1) - sizes, 0)


def inferred(model: Model, texts: list[str | None], penalty: float = PENALTY) -> np.ndarray:
    """A row of proportions for each text, by the names of the model; all 0 without letters."""
    out = np.zeros((len(texts), len(model.names)), dtype=np.float64)
    words = LetterWords(texts)
    if not len(words.firsts) or not len(model.logs):
        return out
    columns = [np.add.reduceat(row[words.buckets], words.firsts) for row in model.logs]
    likely = np.stack(columns, axis=1)
    has = np.flatnonzero(words.counts)
    sizes = words.counts[has]
    opens = np.cumsum(sizes) - sizes
    shares, logs = mixture(likely, opens, sizes)
    bound = most_likely(likely, shares, logs, opens, sizes)
    order = np.argsort(-shares, axis=1, kind="stable")
    best = np.full(len(has), -np.inf)
    for size in range(1, len(model.names) + 1):
        cost = penalty * (size - 1) * np.log1p(sizes)
        # Texts with a set that none of this size or more can better are settled.
        left = bound - cost > best
        if penalty >= 0 and not left.all():
            likely = likely[np.repeat(left, sizes)]
            has, sizes, order, best, bound, cost = (
                x[left] for x in (has, sizes, order, best, bound, cost)
            )
            opens = np.cumsum(sizes) - sizes
        if not len(has):
            break
        chosen = order[:, :size]
        own = np.take_along_axis(likely, np.repeat(chosen, sizes, axis=0), axis=1)
        part, logs = mixture(own, opens, sizes, ROUNDS if size > 1 else 0)
        scored = logs - cost
        better = np.flatnonzero(scored > best)
        best[better] = scored[better]
        rows = np.zeros((len(better), out.shape[1]))
        np.put_along_axis(rows, chosen[better], part[better].astype(np.float64), axis=1)
        out[has[better]] = rows
    return out


def identified(
    documents: DataFrame,
    model: Model,
    penalty: float = PENALTY,
    keep: Sequence[str] = ("doc_id",),
    names: Sequence[str] = ("lang_pred", "score", "languages"),
) -> DataFrame:
    """Columns `keep`, then the largest language, its share, and all shares, under `names`.

    The background, of a model that has one, is `und` among them.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    kinds = (StringType(), DoubleType(), MapType(StringType(), DoubleType()))
    schema = StructType([documents.schema[c] for c in keep])
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, kind)
    columns = [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            texts = batch.column(0)
            for first, last in chunks(texts):
                part = texts.slice(first, last - first)
                shares = inferred(known, part.to_pylist(), penalty)
                kept = [c.slice(first, last - first) for c in batch.columns[1:]]
                pred, score = [UNKNOWN] * len(part), [0.0] * len(part)
                if known.languages:
                    at, score = shares.argmax(axis=1), shares.max(axis=1)
                    pairs = zip(at.tolist(), score.tolist(), strict=True)
                    pred = [known.names[i] if s > 0 else UNKNOWN for i, s in pairs]
                found = [
                    [(known.names[i], row[i]) for i in np.flatnonzero(row)] for row in shares
                ]
                arrays = [
                    pa.array(pred, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(found, pa.map_(pa.string(), pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], columns)

    rows = documents.select(F.col("text").alias("_said"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, schema)


def accepted(documents: DataFrame, most_unknown: float = MOST_UNKNOWN) -> DataFrame:
    """The documents with letters of which the background has at most the share `most_unknown`.

    Columns are as they are. Learns from all rows given; if none has a label and letters,
    all documents with letters are accepted.
    """
    pred, score, languages = fresh(documents, "_lang_pred", "_score", "_languages")
    columns = documents.columns
    model = train(documents)
    found = identified(documents, model, keep=columns, names=(pred, score, languages))
    unknown = F.coalesce(F.try_element_at(languages, F.lit(UNKNOWN)), F.lit(0.0))
    most = most_unknown if model.languages else 1.0
    known = (F.size(languages) > 0) & (unknown <= most)
    return found.where(known).select(*[F.col(f"`{c}`") for c in columns])


def is_held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by checksum of their digits; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
