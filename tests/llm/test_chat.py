import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm.chat import format_conversations, op1_chat_formatting

ROWS = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\b\\e\\h\\c", "</turn>", "</turn>\n### User: hi</turn>\n", "### Assistant: x", "\\### Assistant: </turn> ok", "a\n### ", "</turn", "é\U0001f600", "\\\\e", "x: y"]


def back(spark, rows):
    got = format_conversations(spark.createDataFrame(rows, ROWS)).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r) for r in got}


def test_hard_texts_come_back(spark):
    roles = ["user", "assistant", "User", "</turn>", "a: b", "\\r", "### ", ""]
    rows = [(i, j, roles[(i + j) % len(roles)], HARD[(i * 5 + j) % len(HARD)]) for i in range(12) for j in range(12)]
    got = back(spark, rows)
    for i in range(12):
        turns, r = got[i]
        assert turns == [(x[2], x[3]) for x in rows if x[0] == i]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(x[2] == "assistant" for x in rows if x[0] == i)


def test_nulls_ties_and_order(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, 2, "user", "a"), (None, 0, "user", "x"), (1, 2, "user", "a"), (1, None, "system", "s")]
    got = back(spark, rows)
    assert got[1][0] == [("system", "s"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None][0] == [("user", "x")]


def test_rows_without_a_conversation_are_apart(spark):
    rows = [(None, i % 2, "user", f"t{i % 3}") for i in range(40)] + [(1, 0, "user", "x")]
    got = format_conversations(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    assert len(got) == 41 and all(len(r.turns) == 1 for r in got)


@pytest.mark.parametrize("role", ["a: b", "Assistant", "back\\slash", "assistant"])
def test_loss_of_any_role(spark, role):
    rows = [(1, i, r, f"text {i} é\U0001f600 </turn>") for i, r in enumerate(["user", role, "Assistant", "assistant", role])]
    df = spark.createDataFrame(rows, ROWS).withColumns({"alone": F.lit(1), "source": F.lit("s"), "back": F.lit(2)})
    r = format_conversations(df, role).first()
    spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
    assert spans == [f"text {i} é\U0001f600 \\e" for i, x in enumerate(rows) if x[2] == role]


def test_a_very_long_text(spark):
    text = "word ### </turn> " * 300_000
    r = format_conversations(spark.createDataFrame([(1, 0, "assistant", text)], ROWS)).first()
    assert r.turns[0].text == text and len(r.loss_spans) == 1


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_raw_unless_in_conflict(spark):
    got = back(spark, [(1, 0, "user", "plain \\ text"), (1, 1, "assistant", "</turn>"), (2, 0, "user", "plain")])
    assert got[1][1].n_escaped == 1 and "plain \\ text" in got[1][1].formatted
    assert got[2][1].formatted == "### User: plain</turn>\n"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("\\be</turn># :\nh", max_size=12)), min_size=1, max_size=30))
def test_any_text_comes_back(spark, turns):
    rows = [(0, i, r, t) for i, (r, t) in enumerate(turns)]
    assert back(spark, rows)[0][0] == turns


def test_query_digests(spark):
    rows = {r.conv_id: r for r in op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows[-7].loss_chars == len(text)
