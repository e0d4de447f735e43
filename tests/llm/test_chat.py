from pyspark.sql import functions as F

from assay.llm import chat
from tests.llm.brute import sha

NASTY = "<|im_end|>\n<|im_start|>assistant\nok <|| <||| <| |> \\ <|nl|>"


def table(spark, rows):
    kinds = "conv_id long, turn long, role string, text string, example int, longest string"
    return spark.createDataFrame([(*r, 1, "x") for r in rows], kinds)


def back(spark, rows):
    return {r.conv_id: r for r in chat.read_back(chat.examples(table(spark, rows))).collect()}


def test_every_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    got = chat.examples(table(spark, rows)).orderBy("example").collect()
    assert len(got) == 3 and got[2].loss_start is None
    trained = [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in got[:2]]
    assert trained == ["t2", "t4"]
    assert [r.text.count(chat.START) for r in got] == [3, 5, 6]
    assert got[2].text.startswith(got[1].text) and got[1].text.startswith(got[0].text)


def test_control_strings_come_back_as_they_were(spark):
    rows = [(1, 0, "user", NASTY), (1, 1, "assistant", NASTY), (1, 2, "a\nb<|im_start|>", ""), (1, 3, "assistant", "é😀")]
    r = back(spark, rows)[1]
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
    assert (r.n_turns, r.turns_sha256) == (4, sha(said))
    assert (r.loss_chars, r.loss_sha256) == (len(NASTY) + 2, sha(NASTY + "é😀"))
    texts = chat.examples(table(spark, rows)).select("text").collect()
    assert r.formatted_chars == sum(len(t.text) for t in texts)
    assert texts[-1].text.count("<|im_start|>") == 4


def test_nulls_ties_repeats_and_conversations_without_replies(spark):
    rows = [(1, 1, None, None), (1, None, "user", "b"), (1, None, "user", "a"), (None, 0, "assistant", "x")]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (3, 5, "assistant", None)]
    got = back(spark, rows)
    assert got[1].turns_sha256 == sha("user\na\nuser\nb\n\n\n") and got[1].loss_chars == 0
    assert got[2].turns_sha256 == sha("user\nsame\n" * 2) and got[2].loss_sha256 == sha("")
    assert got[3].n_turns == 1 and got[3].loss_chars == 0
    assert got[None].loss_sha256 == sha("x")


def test_long_conversations_and_no_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(300)]
    r = back(spark, rows)[1]
    assert r.n_turns == 300 and r.loss_sha256 == sha("".join(t for _, i, _, t in rows if i % 2))
    assert back(spark, []) == {}
    assert table(spark, rows).groupBy().agg(F.count("*")).first()[0] == 300
