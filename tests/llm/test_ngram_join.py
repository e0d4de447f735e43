import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import ngram_join
from tests.llm import brute


def joined(docs, rows):
    found = ngram_join.linked(docs(rows)).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def edited(words, rate, rng):
    return [rng.choice("xyz") + str(rng.random())[:6] if rng.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Groups of near copies around the threshold, of texts from one word to thousands."""
    rng = random.Random(5)
    rows, doc_id = [], 0
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 20, 33, 60, 120, 400, 2500):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for rate in (0, 0, 0.01, 0.02, 0.03, 0.05):
                rows.append((doc_id, " ".join(edited(base, rate, rng))))
                doc_id += 1
            rows.append((doc_id, " ".join(base[: max(1, size * 4 // 5)])))
            rows.append((doc_id + 1, " ".join([*base, *[f"v{rng.random()}" for _ in range(size // 4)]])))
            doc_id += 2
    rng.shuffle(rows)
    return rows


def test_components_as_by_brute_force(docs, corpus):
    want = sorted(brute.components(corpus), key=str)
    assert joined(docs, corpus) == want
    assert len({c for _, _, c in want}) < len(want) * 0.8


def test_a_large_group_of_near_copies_and_a_passage_that_many_share(docs):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(edited(base, 0.01, rng))) for i in range(150)]
    for i in range(150, 300):
        rows.append((i, " ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(60)]])))
    assert joined(docs, rows) == sorted(brute.components(rows), key=str)


def test_blocks_give_out_links_that_join_and_no_pairs(docs, monkeypatch):
    """Of a large group of copies that mostly do not link, pairs stay in the blocks, of which there are many."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, rng.choice((0.01, 0.02, 0.03)), rng))) for i in range(500)]
    rows += [(i, f"{rows[i % 40][1]} {i}") for i in range(500, 520)]
    seen = []

    def counted(*given, do=ngram_join.crossing_links):
        links = do(*given)
        seen.append((given[0].count(), given[0].select("node").distinct().count(), links.count()))
        return links

    monkeypatch.setattr(ngram_join, "crossing_links", counted)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    want = sorted(brute.components(rows), key=str)
    assert joined(docs, rows) == want
    (_, nodes, links), = seen
    assert nodes > 100
    assert links < 4 * nodes


def test_pairs_are_verified_at_the_first_signature_they_share():
    lists = [np.array(x, dtype=np.int64) for x in ([1, 5], [5, 9000], [7], [], range(8000, 9001))]
    i, j = np.triu_indices(5, 1)
    want = [bool(set(lists[a].tolist()) & set(lists[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert ngram_join.sharing(lists, i, j).tolist() == want


def test_nulls_empty_texts_ties_and_repeats(docs):
    rows = [(3, None), (4, ""), (5, " \n\t"), (7, "A b"), (6, "a B"), (6, "a B"), (2, "one two three four five"), (1, "one two three four six")]
    want = [(1, 1, 1), (2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (6, 1, 6), (7, 1, 6)]
    assert joined(docs, rows) == sorted(want, key=str)


def test_a_null_id_brings_nothing_together(docs):
    rows = [(None, "a b c d e f"), (9, "a b c d e f"), (None, "alone here")]
    assert joined(docs, rows) == sorted([(None, 2, 9), (9, 2, 9), (None, 1, None)], key=str)


def test_empty_tables_and_tables_without_words(docs):
    assert joined(docs, []) == []
    assert joined(docs, [(1, None)]) == [(1, 0, 1)]


def test_representatives_keep_one_of_each_group_and_all_columns(docs):
    text = " ".join(f"w{i}" for i in range(50))
    near = text + " more"
    df = docs([(1, near), (2, text), (2, text), (3, ""), (3, ""), (4, "other words"), (None, "no id at all")])
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(1, near), (3, ""), (3, ""), (4, "other words"), (0, "no id at all")])


def test_representatives_keep_different_texts_of_null_and_repeated_ids(docs):
    one, two, three = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, one), (None, two), (None, two.upper()), (5, three), (None, three)]
    # Id 7 has a text near that of 6, and one that links with nothing.
    four, five = (" ".join(f"{x}{i}" for i in range(50)) for x in "de")
    rows += [(6, four), (7, four + " more"), (7, five), (8, five + " more"), (9, one[:40]), (9, two[:40])]
    kept = ngram_join.representatives(docs(rows)).select("doc_id", F.lower("text"))
    want = [(None, one), (None, two), (5, three), (6, four), (7, five), (9, one[:40]), (9, two[:40])]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    ids = {(d, c) for d, _, c in joined(docs, rows)}
    assert ids == {(None, None), (None, 5), (5, 5), (6, 6), (7, 6), (7, 7), (8, 7), (9, 9)}


def test_every_linked_pair_has_a_signature_in_common():
    rng = np.random.default_rng(7)
    sizes = [*range(1, 40), 77, 150, 640]
    # Many sets in a window make one-deletion segments and spare ones pay.
    for there in (10, 10**9):
        windows = {n: ngram_join.allocated(n, there) for n in range(20)}
        for size in sizes:
            for _ in range(20):
                base = rng.integers(0, 2**63, size, dtype=np.uint64)
                other_size = int(rng.integers(size * 3 // 4, size + 1)) or 1
                both = int(np.ceil(75 * (size + other_size) / 175))
                if both > other_size:
                    continue
                fresh = rng.integers(0, 2**63, other_size - both, dtype=np.uint64)
                a, b = np.sort(base), np.sort(np.concatenate((base[:both], fresh)))
                many = np.array([len(a), len(b)])
                rows, sigs = ngram_join.signatures(np.concatenate((a, b)), many, windows)
                assert set(sigs[rows == 0]) & set(sigs[rows == 1]), (size, other_size, there)


def test_costs_choose_one_deletion_segments_for_small_sets_of_large_corpora():
    kinds = {n: ngram_join.allocated(n, 10**9) for n in range(12)}
    assert any(w.deletions for w in kinds.values())
    for w in kinds.values():
        most = int(ngram_join.differing(np.int64(w.high - 1), np.int64(w.top)))
        assert w.segments + w.deletions >= most + 1
