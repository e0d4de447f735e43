import random

import pytest

from assay.llm import decontaminate
from tests.llm import brute


def digests(docs, spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digested(decontaminate.matched(docs(rows), bench, **options))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)


def wanted(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        n, hit, names = brute.contamination(text, items, window)
        out.append((doc_id, n, len(hit), len(names), brute.sha(",".join(names)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    """Few different words, so that partial matches abound."""
    rng = random.Random(11)
    words = ["a", "B", "c3", "é", "dd"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(12, 40)]
    items = [(i, t) for i, t in items if len(t.split()) > 4]
    rows = []
    for doc_id in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(120))]
        if doc_id % 3 == 0:
            parts[10:10] = rng.choice(items)[1].lower().split()[: rng.randrange(4, 20)]
        rows.append((doc_id, rng.choice([" ", "-", ", "]).join(parts)))
    return rows, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 20}])
def test_hits_as_by_brute_force(docs, spark, corpus, options):
    rows, items = corpus
    want = wanted(rows, items)
    assert digests(docs, spark, rows, items, **options) == want
    assert 5 < sum(w[5] for w in want) < 60


def test_other_windows_and_one_word_items(docs, spark, corpus):
    rows, items = corpus
    few = [*items[:3], (99, "c3"), (98, "é dd")]
    assert digests(docs, spark, rows, few, window=4) == wanted(rows, few, 4)


def test_nulls_empty_and_equal_items_and_texts(docs, spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, "?!"), (4, f"x {item.upper()} y"), (4, f"x {item.upper()} y"), (5, "q3")]
    items = [(7, item), (8, item), (9, None), (10, "..."), (None, item)]
    got = digests(docs, spark, rows, items)
    names = brute.sha(",7,8")
    assert [g[:3] for g in got] == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 14, 12), (4, 14, 12), (5, 1, 0)]
    assert got[3][3:] == (3, names, True)


def test_no_items_and_no_documents(docs, spark):
    assert digests(docs, spark, [(1, "a b")], []) == [(1, 2, 0, 0, brute.sha(""), False)]
    assert digests(docs, spark, [(1, "a b")], [(1, None)]) == [(1, 2, 0, 0, brute.sha(""), False)]
    assert digests(docs, spark, [], [(1, "a")]) == []


def test_a_long_text_is_read_to_its_end(docs, spark):
    item = " ".join(f"q{i}" for i in range(10))
    rows = [(1, "filler words " * 300_000 + item)]
    assert digests(docs, spark, rows, [(1, item)])[0][:3] == (1, 600_010, 10)


def test_spans_go_and_mostly_hit_documents_too(docs, spark):
    item = " ".join(f"q{i}" for i in range(20))
    rest = " ".join(f"r{i}" for i in range(60))
    df = docs([(1, f"{rest}\n{item}, tail é"), (2, f"{item} x"), (3, "clean"), (4, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: f"{rest}\n, tail é", 3: "clean", 4: None}


def test_the_automaton_knows_every_run_and_nothing_else():
    rng = random.Random(2)
    items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))]) for i in range(8)]
    automaton = decontaminate.SuffixAutomaton(items, 3)
    for _ in range(200):
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)]
        got = {(at, n, i) for at, n, found in automaton.stream(text) for i in found}
        want = set()
        for i, (_, own) in enumerate(items):
            n = min(3, len(own))
            runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            want |= {(at, n, i) for at in range(n, 21) if tuple(text[at - n : at]) in runs}
        assert got == want
