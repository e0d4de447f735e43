import itertools
import math

import numpy as np
import pytest

from assay.llm import language

EN = "the other day when they were thinking that the weather would change again"
DE = "der andere tag als sie dachten dass sich das wetter wieder einmal ändern würde"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN, "en"), (EN, "en"), (DE, "de"), (None, "fr"), ("quelque chose", None), ("123", "xx")]
    return language.train(spark.createDataFrame(rows, "text string, lang string"))


def found(spark, model, texts, **options):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in language.identified(df, model, **options).collect()}


def test_only_texts_with_a_label_and_letters_teach(model):
    assert model.languages == ("de", "en")


def test_one_language_takes_all_of_a_plain_text(spark, model):
    rows = found(spark, model, [EN, DE, EN.upper()])
    assert [(rows[i].lang_pred, rows[i].score) for i in range(3)] == [("en", 1.0), ("de", 1.0), ("en", 1.0)]


def test_a_mixed_text_has_both_languages(spark, model):
    row = found(spark, model, [f"{EN} {EN} {EN} {DE}"])[0]
    assert row.lang_pred == "en" and set(row.languages) == {"en", "de"}
    assert 0.6 < row.score < 0.85 and abs(sum(row.languages.values()) - 1) < 1e-4


def test_a_high_penalty_leaves_one_language(spark, model):
    assert found(spark, model, [f"{EN} {DE}"], penalty=1e6)[0].score == 1.0


def seven():
    """A model of seven languages with letters of their own, and a text of each."""
    said = [
        " ".join("".join(chr(0x4E00 + 64 * lang + (7 * i + 3 * j * j) % 26) for j in range(6)) for i in range(26))
        for lang in range(7)
    ]
    buckets = [language.LetterWords([t]).buckets for t in said]
    counts = {f"l{i}": 5_000 * np.bincount(b, minlength=language.BUCKETS) for i, b in enumerate(buckets)}
    return language.Model.of(counts), said


def test_a_text_has_as_many_languages_as_it_says():
    model, said = seven()
    for many in range(1, len(said) + 1):
        row = language.inferred(model, [" ".join(said[:many] * 3)])[0]
        assert np.flatnonzero(row).tolist() == list(range(many))
        assert row[:many] == pytest.approx(1 / many, abs=0.01)


def test_settling_early_changes_nothing():
    model, said = seven()
    rng = np.random.default_rng(3)
    words = " ".join(said).split() + ["xqzv", "jkwq", "zzz"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(200)]
    early = language.inferred(model, texts)
    settled, language.most_likely = language.most_likely, lambda *a: np.full(len(a[2]), np.inf)
    try:
        assert np.allclose(early, language.inferred(model, texts))
    finally:
        language.most_likely = settled


def test_without_letters_a_text_is_undetermined(spark, model):
    rows = found(spark, model, [None, "", "12 !? \n", "é"])
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(rows[i].score == 0 for i in range(3)) and rows[3].lang_pred != "und"


def test_long_texts_are_read_whole(spark, model):
    rows = found(spark, model, [(EN + " ") * 100 + (DE + "\n") * 20_000])
    assert rows[0].lang_pred == "de" and rows[0].score > 0.98


def test_nothing_learned_and_nothing_given(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = language.train(empty)
    assert model.languages == ()
    assert found(spark, model, [EN])[0].lang_pred == "und"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language.identified(none, model).collect() == []


def test_accepted_keeps_rows_as_they_are(spark):
    rows = [(1, EN, "en", "x"), (1, EN, "en", "x"), (2, None, "en", "y"), (3, "42", None, "z"), (4, DE, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _score string")
    kept = language.accepted(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


def test_accepted_rejects_what_is_in_no_learned_language(spark):
    """Letters alone do not make a text one of a learned language; a mixed text stays."""
    unlabelled = "wszyscy ludzie rodzą się wolni oraz równi pod względem swej godności"
    gibberish = "xqzv wkjq zzpfx qvbnm jxkw vvqz kqxj wzxcv pqgh jjkz"
    given = [(1, EN, "en"), (2, f"{EN} {DE} {EN} {DE}", "en"), (3, gibberish, "en"), (4, unlabelled, None), (5, f"{EN} {gibberish}", "de")]
    rows = spark.createDataFrame(given, "doc_id long, text string, lang string")
    many = spark.range(20_000).selectExpr(
        "cast(null as long) as doc_id", f"if(id % 2 = 0, '{EN}', '{DE}') as text", "if(id % 2 = 0, 'en', 'de') as lang"
    )
    kept = language.accepted(many.unionByName(rows)).where("doc_id is not null")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    model = language.train(many)
    row = found(spark, model, [gibberish])[0]
    assert (row.lang_pred, row.languages) == ("und", {"und": row.score}) and row.score == 1.0


def test_without_a_background_every_text_with_letters_has_a_learned_language(spark, model):
    rows = found(spark, model.learned(), ["xqzv wkjq zzpfx", "wszyscy ludzie", "12", None, EN])
    assert {rows[0].lang_pred, rows[1].lang_pred} <= {"de", "en"}
    assert [rows[i].lang_pred for i in (2, 3, 4)] == ["und", "und", "en"]
    assert all(abs(sum(rows[i].languages.values()) - 1) < 1e-4 for i in (0, 1, 4))


def test_accepted_keeps_texts_with_letters_where_nothing_is_labelled(spark):
    rows = [(1, EN), (2, "42 !"), (3, None), (4, DE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    assert sorted(r.doc_id for r in language.accepted(df).collect()) == [1, 4]


def plain_mixture(likely, rounds=language.ROUNDS):
    """Proportions and log likelihood of one text, one word at a time."""
    shares = [1 / len(likely[0])] * len(likely[0])
    for _ in range(rounds):
        sums = [0.0] * len(shares)
        for word in likely:
            parts = [s * math.exp(x) for s, x in zip(shares, word, strict=True)]
            for i, part in enumerate(parts):
                sums[i] += part / sum(parts)
        shares = [s / len(likely) for s in sums]
    logs = sum(math.log(sum(s * math.exp(x) for s, x in zip(shares, word, strict=True))) for word in likely)
    return shares, logs


def test_the_set_is_the_best_of_all_subsets_by_a_plain_mixture():
    model, said = seven()
    model = language.Model(model.languages[:3], model.logs[:3])
    rng = np.random.default_rng(5)
    pools = [t.split() for t in said[:3]]
    texts = []
    for _ in range(60):
        own = rng.choice(3, rng.integers(1, 4), replace=False)
        texts.append(" ".join(rng.choice(pools[p]) for p in rng.choice(own, rng.integers(1, 40))))
    for text, row in zip(texts, language.inferred(model, texts), strict=True):
        words = language.LetterWords([text])
        likely = np.stack([np.add.reduceat(r[words.buckets], words.firsts) for r in model.logs], axis=1)
        best = {}
        for size in (1, 2, 3):
            for chosen in itertools.combinations(range(3), size):
                shares, logs = plain_mixture(likely[:, chosen].astype(float).tolist())
                best[chosen] = (logs - language.PENALTY * (size - 1) * math.log1p(len(likely)), shares)
        chosen = max(best, key=lambda c: best[c][0])
        assert tuple(np.flatnonzero(row > 1e-6).tolist()) == chosen
        assert row[list(chosen)] == pytest.approx(best[chosen][1], abs=1e-3)


def test_a_null_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.select(language.is_held_out(df.doc_id)).collect()][0] is False
