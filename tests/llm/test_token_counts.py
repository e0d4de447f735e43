from assay.llm import token_counts


def test_totals_for_every_limit(docs):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "word " * 500), (5, "日本語 <|endoftext|>")]
    encode = token_counts.encoding().encode_ordinary
    sizes = sorted(len(encode(t or "")) for _, t in rows)
    counts = token_counts.histogram(token_counts.token_lengths(docs(rows)))
    assert sorted(r.context for r in counts.collect()) == sorted(set(sizes))
    for limit in (0, 1, sizes[2], 300, 10**6):
        got = token_counts.at_limit(counts, limit)
        assert got["docs_within"] == sum(s <= limit for s in sizes)
        assert got["tokens_within"] == sum(s for s in sizes if s <= limit)
        assert got["tokens_cut"] == sum(min(s, limit) for s in sizes)
    assert token_counts.quantile(counts, 0.5) == sizes[2]
    assert token_counts.quantile(counts, 1.0) == sizes[-1]


def test_no_documents(docs):
    counts = token_counts.histogram(token_counts.token_lengths(docs([])))
    assert counts.collect() == []
    assert token_counts.at_limit(counts, 5) == {"docs_within": 0, "tokens_within": 0, "tokens_cut": 0}
    assert token_counts.quantile(counts, 0.5) is None
