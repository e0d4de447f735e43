import random

from pyspark.sql import functions as F

from assay.llm import line_dedup
from tests.llm import brute

LONG = "this line is long enough to be dropped when repeated"


def kept(docs, rows, **options):
    found = line_dedup.dedup_lines(docs(rows), **options)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found.collect()), key=str)


def test_lines_as_by_brute_force(docs):
    rng = random.Random(3)
    lines = [f"{LONG} number {i}" for i in range(12)] + ["short", "", "  "]
    rows = []
    for doc_id in range(60):
        some = [rng.choice(lines) for _ in range(rng.randrange(12))]
        rows.append((doc_id, "\n".join(rng.choice([x, x.upper(), f"\t{x} \r"]) for x in some)))
    want = sorted(brute.kept_lines(rows), key=str)
    assert kept(docs, rows) == want
    assert kept(docs, rows, batches=3) == want
    assert sum(w[2] for w in want) > 50


def test_only_the_largest_id_keeps_a_line_and_all_its_repeats(docs):
    rows = [(i, f"a\n{LONG}\n{LONG}\nb") for i in range(5)]
    assert kept(docs, rows) == [(i, 4, 2, "a\nb") for i in range(4)] + [(4, 4, 0, rows[4][1])]
    assert all(r[2] == 0 for r in kept(docs, rows[:4]))


def test_nulls_empty_texts_and_repeated_ids(docs):
    rows = [(1, None), (2, ""), (None, LONG), (None, LONG), (7, LONG), (7, f"{LONG}\nx")]
    rows += [(i, LONG) for i in (4, 5, 6)]
    got = kept(docs, rows)
    want = [(1, 1, 0, ""), (2, 1, 0, ""), (7, 1, 0, LONG), (7, 2, 0, f"{LONG}\nx")]
    want += [(None, 1, 1, "")] * 2 + [(i, 1, 1, "") for i in (4, 5, 6)]
    assert got == sorted(want, key=str)


def test_trims_ascii_space_only_and_counts_code_points(docs):
    odd = "\u00a0" + "é" * 39
    rows = [(i, f" {odd}\x0b") for i in range(5)] + [(i, "\x1c" + "é" * 38) for i in range(5, 10)]
    assert [r[2] for r in kept(docs, rows)] == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_other_columns_stay_and_untouched_texts_too(docs):
    df = docs([(1, None), (2, "x")])
    found = line_dedup.dedup_lines(df)
    assert found.columns == [*df.columns, "n_lines", "n_dropped"]
    assert found.where("text is null").count() == 1
    assert line_dedup.dedup_lines(docs([])).collect() == []


def test_runs_are_merged_by_level_and_tell_new_lines(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for start in range(0, 50, 10):
        rows = [(f"{i}".encode(), i) for i in range(start, start + 20)]
        batch = spark.createDataFrame(rows, "hash binary, doc_id long")
        new = {int(bytes(r.hash)) for r in runs.novel(batch).collect()}
        assert new == set(range(start if start == 0 else start + 10, start + 20))
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {int(bytes(r.hash)): r.docs for r in runs.merged(runs.read()).collect()}
    assert merged == {i: 1 if i < 10 or i >= 50 else 2 for i in range(60)}
    for path in (p for level in runs.levels for p in level):
        files = spark.read.parquet(path).select("hash", F.input_file_name().alias("f")).collect()
        for name in {r.f for r in files}:
            own = [bytes(r.hash) for r in files if r.f == name]
            assert own == sorted(own)
