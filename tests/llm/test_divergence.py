import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assay.llm import divergence
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def f(p, q):
    return (p - q) ** 2 // q


def plain(rows, least=3, ranks=200):
    """The audit of (text, lang, source) rows, every pair and term priced by itself."""
    rows = [tuple(x or "" for x in r) for r in rows]
    said, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall(text.translate(brute.LOWER))
        said[lang, source].update(words)
        holders[lang].update(set(words))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in holders[lang].items() if n >= least)
        sources = sorted({s for _, la, s in rows if la == lang}, key=str.encode)

        def chance(counts, total):
            return 1 + 1_000_000_000 * (counts + 1) // (total + len(kept))

        totals = {s: sum(said[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(said[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: chance(said[lang, s][t], totals[s]) for t in kept} for s in sources}
        q = {t: chance(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if said[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def audit(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, n int, term string, value double")
    return sorted(map(tuple, divergence.audited(df, **options).collect()))


def corpus(rng, docs, sources, vocabulary):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'é' * (i // 100)}" for i in range(vocabulary)]
    return [
        (" ".join(words[i].upper() if i % 3 else words[i] for i in rng.zipf(1.3, rng.integers(0, 40)) % vocabulary), str(rng.choice(["en", "de"])), f"s{rng.integers(sources)}")
        for _ in range(docs)
    ]


@pytest.mark.parametrize("sources", [1, 3, 12])
def test_as_by_pricing_every_cell(spark, sources):
    rows = corpus(np.random.default_rng(sources), 120, sources, 300)
    assert audit(spark, rows) == plain(rows)
    assert audit(spark, rows, term_ranks=4, least_docs=1) == plain(rows, 1, 4)


def test_blocks_tiles_and_a_small_frontier_change_nothing(spark, monkeypatch):
    rows = corpus(np.random.default_rng(9), 150, 11, 200)
    want = plain(rows)
    monkeypatch.setattr(divergence, "CELLS", 400)
    assert audit(spark, rows) == want
    spot = divergence._priced.__globals__
    monkeypatch.setitem(spot, "TILE", 4)
    monkeypatch.setitem(spot, "FRONTIER", 16)
    assert audit(spark, rows) == want


def test_nulls_empty_texts_and_languages_that_keep_nothing(spark):
    rows = [("a b c", "en", "x"), ("a b", "en", "x"), ("A? a-b", "en", None), (None, "en", "z"), ("", None, "x"), (None, None, None), ("rare", "fr", "x"), ("odd", "fr", "y"), ("12 _", "de", "x")]
    got = audit(spark, rows)
    assert got == plain(rows)
    assert {r[4] for r in got if r[0] in ("fr", "")} == {0}
    assert audit(spark, []) == []


def test_a_long_text_is_read_whole(spark):
    rows = [("tail " * 3 + "head " * 300_000, "en", "a"), ("head", "en", "b"), ("head end", "en", "b"), ("end", "en", "a"), ("end tail", "en", "c"), ("tail", "en", "c")]
    assert audit(spark, rows) == plain(rows)


def test_trees_hold_what_they_were_given():
    rng = np.random.default_rng(4)
    for levels in (1, 3, 5):
        side = 1 << levels
        matrix = np.where(rng.random((side, side)) < 0.2, rng.integers(1, 9, (side, side)), 0)
        rows, columns = np.nonzero(matrix)
        tree = divergence.Quadtree(rows, columns, matrix[rows, columns], levels)
        node, r, c = np.zeros(side * side, dtype=int), *(x.ravel() for x in np.indices((side, side)))
        for level in range(levels):
            left = levels - level - 1
            node = tree.children(level, node, 2 * (r >> left & 1) + (c >> left & 1))
        assert (tree.cells(node) == matrix.ravel()).all()
        assert sum(len(b) for b in tree.bits) <= 4 * (1 + levels * len(rows))


@pytest.mark.parametrize(("many", "width", "share"), [(1, 1, 1.0), (5, 70, 0.05), (9, 33, 0.5), (4, 10, 0.0)])
def test_joint_prices_equal_those_of_every_cell(many, width, share):
    rng = np.random.default_rng(width)
    matrix = np.where(rng.random((many, width)) < share, rng.integers(1, 50, (many, width)), 0)
    levels = max(width - 1, many - 1, 1).bit_length()
    rows, columns = np.nonzero(matrix)
    tree = divergence.Quadtree(rows, columns, matrix[rows, columns], levels)
    totals = matrix.sum(axis=1) + width
    p = divergence.probability(matrix, totals[:, None])
    assert p.tolist() == [[1 + 10**9 * (int(n) + 1) // int(t) for n in row] for row, t in zip(matrix, totals, strict=True)]
    want = [[sum(f(int(a), int(b)) for a, b in zip(p[i], p[j], strict=True)) for j in range(many)] for i in range(many)]
    assert divergence.joint_prices(tree, tree, totals, totals, width).tolist() == want


def test_probabilities_of_counts_beyond_any_product():
    total = np.array([9 * 10**14 + 7])
    for n in (0, 5, 10**14, 9 * 10**14 + 6):
        assert divergence.probability(np.array([n]), total)[0] == 1 + 10**9 * (n + 1) // int(total[0])
