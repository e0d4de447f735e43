"""The pipeline against plain versions of its stages, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import decontaminate
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    return corpus_pipeline.run(spark, SF_DIR).cache()


def plain():
    """doc_id, text before mixing. All given documents have letters and one language."""
    rows = duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet' order by 1").fetchall()
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    rows = [(d, text) for d, _, dropped, text in brute.kept_lines(rows)]
    smallest = {d: c for d, _, c in brute.components(rows)}
    rows = [(d, t) for d, t in rows if smallest[d] == d]
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    out = {}
    for doc_id, text in rows:
        n, hit, _ = brute.contamination(text, items)
        if len(hit) <= decontaminate.COVERAGE * n:
            places = sorted(hit)
            firsts = [p for p in places if p - 1 not in hit]
            spans = [(p, next(q for q in range(p, n + 1) if q not in hit)) for p in firsts]
            out[doc_id] = decontaminate.cut(text, spans) if spans else text
    return out


def test_the_mix_has_what_plain_stages_keep(mixed):
    want = plain()
    got = mixed.collect()
    assert {r.doc_id for r in got} <= set(want)
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in got)
    source = {r.source for r in got}
    words = {s: 0 for s in source}
    for r in got:
        words[r.source] += len(r.text.split())
    assert sum(words.values()) == pytest.approx(1.5 * sum(len(t.split()) for t in want.values()), rel=0.15)


def test_copies_are_numbered(mixed):
    odd = mixed.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).where("m <> n")
    assert odd.isEmpty() and mixed.columns[-1] == "copy"


def test_nothing_of_the_benchmark_is_left(mixed):
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    assert not any(brute.contamination(r.text, items)[1] for r in mixed.select("text").distinct().collect())


def test_stages_keep_columns_and_take_odd_tables(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 2), (None, "a b c", "en", "b", 5, 3), (2, "", "en", "a", 0, 2)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _digest int"
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.collect()


@pytest.mark.parametrize("name", ["n_lines", "N_Dropped", "Copy", "_score", "hash", "place"])
def test_stages_keep_the_values_of_columns_named_like_their_own(spark, name):
    said = "a line that is long enough to be dropped where others hold it"
    rows = [(i, f"text of document number {i} about this and that\n{said}", "en", f"s{i % 2}", 77 + i) for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {name} long")
    for stage_name, stage in corpus_pipeline.STAGES:
        if stage_name.startswith(("language", "n-gram")) and name not in ("_score", "_drops", "hash"):
            continue  # these add no column of such a name
        out = stage(spark, docs, SF_DIR)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.select("doc_id", f"`{name}`").collect()
        assert got and all(r[1] == 77 + r[0] for r in got), stage_name
