"""Every query of the subpackage on the smallest tables."""

import hashlib
import importlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from assay.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF_DIR}/documents.parquet'")
    return sorted(rows.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES, ORACLES, SF_DIR) is None


def test_there_is_a_query_for_each_operator_and_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_languages_are_told_apart_on_held_out_documents(spark, documents):
    rows = QUERIES["op1_language_id"](spark, SF_DIR).collect()
    labels = {d: lang for d, _, lang in documents}
    held = [r for r in rows if r.held_out and labels[r.doc_id]]
    assert len(rows) == len(documents) and len(held) > 30
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    learned = {lang for lang in labels.values() if lang}
    texts = {d: t for d, t, _ in documents}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred in learned and r.score > 0) if letters else (r.lang_pred, r.score) == ("und", 0)


def test_near_copies_as_by_brute_force(spark, documents):
    rows = QUERIES["op3_ngram_join"](spark, SF_DIR).collect()
    want = brute.components([(d, t) for d, t, _ in documents])
    assert sorted(map(tuple, rows)) == sorted(want)


def test_token_totals_as_by_encoding_every_text(spark, documents):
    from assay.llm.token_counts import encoding

    sizes = [len(encoding().encode_ordinary(t or "")) for _, t, _ in documents]
    rows = QUERIES["op4_token_counts"](spark, SF_DIR).collect()
    assert {r.context for r in rows} == set(sizes)
    for r in rows:
        assert r.docs_within == sum(s <= r.context for s in sizes)
        assert r.tokens_within == sum(s for s in sizes if s <= r.context)
        assert r.tokens_cut == sum(min(s, r.context) for s in sizes)


def test_ids_as_by_encoding_every_text_in_order(spark, documents):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want, start = [], 0
    for doc_id, text, _ in documents:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op11_id_planes"](spark, SF_DIR).collect())) == want


def test_contamination_as_by_brute_force(spark, documents):
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    want = {}
    for doc_id, text, _ in documents:
        n, hit, names = brute.contamination(text, items)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        want[doc_id] = (doc_id, n, len(hit), len(names), digest, bool(hit))
    rows = QUERIES["op7_decontamination"](spark, SF_DIR).collect()
    assert {r.doc_id: tuple(r) for r in rows} == want
    assert any(r.contaminated for r in rows)


def test_fingerprints_estimate_the_similarity(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, SF_DIR).collect()}
    texts = [t or "" for _, t, _ in documents]
    errors = []
    for (doc_id, _, _), text, following in zip(documents, texts, [*texts[1:], texts[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), brute.sha(edited))
        a, b, c = map(brute.shingle_set, (text, edited, following))
        errors += [row.near_edited - brute.jaccard(a, b), row.near_next - brute.jaccard(a, c)]
    assert max(map(abs, errors)) < 0.12
    assert sum(map(abs, errors)) / len(errors) < 0.02
    prints = {}
    for (doc_id, _, _), text in zip(documents, texts, strict=True):
        assert prints.setdefault(text, rows[doc_id].fingerprint) == rows[doc_id].fingerprint
