import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from assay.llm import encoding

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    whole = Tokenizer.from_file(FILE)
    ours = encoding.Encoder(FILE)
    return ours, lambda text: whole.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_documents(both):
    ours, whole = both
    assert ours.by_words
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text, ids in zip(texts, ours(pa.array(texts)), strict=True):
        assert ids.tolist() == whole(text)


ODD = list(" \n\t\r\x0b\x0c\x1c\x85\xa0    　​᠎'’.,!?-_()[]{}<>|/\\\"#$€×÷…aZsd09éßñÀÿčж中あ가😀ªº²ⅷ́\x00")


def test_odd_characters_in_any_order(both):
    ours, whole = both
    rng = random.Random(8)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(40))) for _ in range(3_000)]
    texts += ["".join(rng.choice(["a", " ", "'s", "'", ".", "\n", "re", "'re", "n't", "9"]) for _ in range(12)) for _ in range(1_000)]
    for text, ids in zip(texts, ours(pa.array(texts)), strict=True):
        assert ids.tolist() == whole(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ours = encoding.encoder(FILE)
    assert ours(pa.array([text]))[0].tolist() == ours.whole([text])[0].tolist()


def test_added_tokens_and_forgetting(both, monkeypatch):
    ours, whole = both
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<| endoftext|>", ""):
        assert ours(pa.array([text]))[0].tolist() == whole(text)
    monkeypatch.setattr(encoding, "REMEMBERED", 3)
    texts = ["one two three. four", "two five\nsix seven", "one"] * 3
    assert [i.tolist() for i in ours(pa.array(texts))] == [whole(t) for t in texts]


def test_other_tokenizers_are_given_whole_texts():
    other = path("word_bpe_49k.json")
    ours = encoding.Encoder(other)
    assert not ours.by_words
    text = "Hello  World. isn't"
    want = Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert np.array_equal(ours(pa.array([text]))[0], want)
