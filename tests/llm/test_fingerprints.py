import random

import numpy as np

from assay.llm import fingerprints
from tests.llm import brute


def compared(docs, rows):
    return sorted(fingerprints.compared(docs(rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_edited_texts_take_from_the_next_document_and_the_last_from_the_first(docs):
    rows = [(i, "abcdefghij"[: i % 11] + "é" * (i % 3)) for i in range(100)]
    random.Random(1).shuffle(rows)
    got = compared(docs, rows)
    texts = dict(rows)
    for r in got:
        own, following = texts[r.doc_id], texts[(r.doc_id + 1) % 100]
        half = len(own) // 2
        assert r.edited_sha256 == brute.sha(own[: len(own) - half] + following[:half])
        assert r.n_chars == len(own)


def test_nulls_empty_texts_repeated_ids_and_a_single_document(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (5, "a b"), (5, "a a"), (None, "x y")]
    got = compared(docs, rows)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5]
    assert [r.n_chars for r in got] == [3, 0, 0, 2, 3, 3]
    assert all(r.fingerprint == "" for r in got[1:4])
    assert got[1].near_next == 1.0 and got[3].near_next == 0.0
    by_text = {r.edited_sha256 for r in got if r.doc_id == 5}
    assert by_text == {brute.sha("a a"), brute.sha("a x")}
    (one,) = compared(docs, [(9, "abcd")])
    assert one.edited_sha256 == brute.sha("abab") and one.near_next == 1.0
    assert compared(docs, []) == []


def test_equal_sets_agree_and_estimates_are_unbiased():
    rng = random.Random(4)
    errors = []
    for size in (3, 20, 100, 800, 5000):
        for share in (0.0, 0.3, 0.75, 0.9, 1.0):
            a = [f"w{rng.random()}" for _ in range(size)]
            b = a[: int(size * share)] + [f"v{rng.random()}" for _ in range(size - int(size * share))]
            texts = [" ".join(a), " ".join(b)]
            one, two = fingerprints.sketches([t.encode() for t in texts])
            near = fingerprints.likenesses(one[None], two[None])[0]
            errors.append(near - brute.jaccard(*map(brute.shingle_set, texts)))
    assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 0.12


def test_short_texts_that_share_nothing_are_unlike_and_estimates_of_short_ones_unbiased():
    rng = random.Random(7)

    def near(pairs):
        found = fingerprints.sketches([t.encode() for pair in pairs for t in pair])
        return fingerprints.likenesses(found[0::2], found[1::2])

    def words(n):
        return [f"w{rng.random()}" for _ in range(n)]

    for shingles in (1, 2, 3, 4, 5):
        size = shingles + 4
        unlike = [(" ".join(words(size)), " ".join(words(size))) for _ in range(500)]
        assert near(unlike).max() < 0.06
        same = [(t, t.upper()) for t, _ in unlike]
        assert near(same).min() == 1.0
        # One word more: all shingles but one of the longer text are those of the shorter.
        longer = [(a, a + " " + words(1)[0]) for a, _ in unlike]
        truth = shingles / (shingles + 1)
        assert abs(near(longer).mean() - truth) < 0.03


def test_fingerprints_follow_words_only(docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text.upper()), (3, text.replace(" ", "\n\t")), (4, text + " more"), (5, "w " * 200_000)]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprinted(docs(rows)).collect()}
    assert got[1] == got[2] == got[3] != got[4]
    assert len(got[1]) == len(got[5]) == 512
