"""Encoding texts with a tokenizer file, each distinct word once per worker.

A byte-level BPE of the usual kind first cuts a text into pieces by a pattern and never
merges across a cut. It always cuts before a space or a line feed that follows no white
space. A text is taken apart there, and what lies between is encoded by the library when
it is met for the first time; the ids of a text are those of its words in order, and equal
those of the whole text. New words are encoded as one text, a line feed between them.
Tokenizers of any other kind, and texts that name one of the added tokens, are
encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker; beyond them it starts anew.
REMEMBERED = 1_000_000

#: Any white space but lone spaces and line feeds between other characters.
_UNSURE = (
    r"  | \n|\n |\n\n|^\n|"
    r"[\t\x0B\x0C\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_SURE = re.compile(r"(?<=\S) ")
#: Words that stay words between line feeds, and those that bring their own.
_PLAIN = re.compile(r" ?\S+")
_LED = re.compile(r"\n\S+")


#: ASCII punctuation but the apostrophe. After one of the others it always begins a piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE_MARKS = frozenset(
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
)


class Encoder:
    """Ids of texts by the tokenizer of a file, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_feed = feed[0] if len(feed) == 1 else None
        self.by_words = _cuts_like_a_byte_level_bpe(said) and self.line_feed is not None
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        # Where the ids of the words begin in `flat`, in the order of their places.
        self.starts, self.flat = array("q", [0]), array("I")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; of a null, none."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return self.whole(texts.to_pylist())
        if len(self.places) > REMEMBERED:
            self._forget()
        unsure = np.asarray(pc.match_substring_regex(texts, _UNSURE))
        for token in self.added:
            unsure |= np.asarray(pc.match_substring(texts, token))
        found: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        sure = np.flatnonzero(~unsure)
        if len(sure):
            for row, ids in zip(sure.tolist(), self._sure(texts.take(pa.array(sure))), strict=True):
                found[row] = ids
        for row in np.flatnonzero(unsure).tolist():
            found[row] = self._unsure(texts[row].as_py())
        return found

    def _sure(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose words are all cut by one space or line feed, which is part of the next word."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        opens = np.asarray(lists.offsets)
        known = lists.flatten().dictionary_encode()
        number, said = known.indices.to_numpy(), known.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._places([w if w[:1] == "\n" else " " + w for w in said])[number]
        firsts = opens[:-1] - opens[0]  # these follow nothing
        at[firsts] = self._places([said[i] for i in number[firsts].tolist()])
        ids, ends = self._ids(at)
        bounds = np.concatenate(([0], ends))[opens[1:] - opens[0]]
        return np.split(ids, bounds[:-1])

    def _unsure(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return self.whole([text])[0]
        units = _SURE.split(text)
        return self._ids(self._places([units[0], *[" " + u for u in units[1:]]]))[0]

    def _places(self, units: list[str]) -> np.ndarray:
        """Where the ids of words are kept; new words are learned."""
        at = np.fromiter(map(self.places.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn({units[i] for i in unknown})
            at[unknown] = [self.places[units[i]] for i in unknown]
        return at

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places, end to end, and where each ends."""
        held = np.frombuffer(self.starts, dtype=np.int64)
        starts, sizes = held[at], held[at + 1] - held[at]
        ends = np.cumsum(sizes)
        spots = np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)
        return np.frombuffer(self.flat, dtype=np.uint32)[spots], ends

    def _learn(self, units: set[str]) -> None:
        """Give new words their places; those before punctuation are learned without it."""
        marked, parts, whole = [], [], set()
        for unit in units:
            bare = unit.rstrip(_MARKS)
            if len(bare) < len(unit) and bare[-1:] in _BEFORE_MARKS:
                marked.append(unit)
                parts += (bare, unit[len(bare) :])
            else:
                whole.add(unit)
        self._encode({p for p in parts if p not in self.places} | whole)
        if marked:
            ids, ends = self._ids(np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts)))
            self._add(marked, ids, ends[1::2])

    def _encode(self, units: set[str]) -> None:
        plain, led, others = [], [], []
        for unit in units:
            kind = plain if _PLAIN.fullmatch(unit) else led if _LED.fullmatch(unit) else others
            kind.append(unit)
        if plain:
            ids = self.whole(["\n".join(plain)])[0]
            feeds = np.flatnonzero(ids == self.line_feed)
            self._add(plain, np.delete(ids, feeds), np.append(feeds, len(ids)) - np.arange(len(plain)))
        if led:
            ids = self.whole(["".join(led)])[0]
            self._add(led, ids, np.append(np.flatnonzero(ids == self.line_feed)[1:], len(ids)))
        if others:
            found = self.whole(others)
            self._add(others, np.concatenate(found), np.cumsum([len(f) for f in found]))

    def _add(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.places.update(zip(units, range(len(self.places), len(self.places) + len(units)), strict=True))
        self.starts.frombytes((ends + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())


def _cuts_like_a_byte_level_bpe(said: dict) -> bool:
    before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    return (
        said.get("normalizer") is None
        and said.get("truncation") is None
        and said.get("padding") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not model.get("dropout")
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
