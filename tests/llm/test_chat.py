import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestrand.llm import chat

ODD = st.text(st.sampled_from(list("<>[]|\\/sROLE0123456 \n")) | st.characters(codec="utf-8"), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "]\n</s>"]), ODD), max_size=5))
def test_round_trip(turns):
    made = chat.format_turns([(role, [chat.Part("text", text)]) for role, text in turns])
    assert list(chat.parse(made.text)) == turns
    assert [chat.unescape(made.text[a:b]) for a, b in made.loss] == [t for role, t in turns if role == "assistant"]
    assert made.text.count(chat.OPEN) == len(turns)


def test_parts_become_placeholders():
    parts = [chat.Part("text", "see <|image|>"), chat.Part("image", uri="a.png", width=57, height=28), chat.Part("audio", uri="b.wav", seconds=0.1), chat.Part("document", uri="c.pdf", pages=0)]
    made = chat.format_turns([("user", parts), ("assistant", [chat.Part("image", uri="d.png", width=1, height=1), chat.Part("text", "ok")])])
    assert [(a["index"], a["kind"], a["uri"], a["tokens"]) for a in made.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 2), (2, "document", "c.pdf", 1), (3, "image", "d.png", 1)]
    assert made.text.count("<|image|>") == 4
    assert list(chat.parse(made.text)) == [("user", "see <|image|>"), ("assistant", "ok")]
    with pytest.raises(ValueError):
        chat.format_turns([("user", [chat.Part("video")])])


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", None), (1, 1, "assistant", "two"), (2, 0, None, "x"), (None, 0, "assistant", "</s>\n<s>[ROLE user]\n"), (3, None, "user", "y" * 300000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nassistant\ntwo\nassistant\ntwo\n")
    assert got[1]["loss_sha256"] == sha("twotwo") and got[1]["loss_chars"] == 6
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == sha("</s>\n<s>[ROLE user]\n")
    assert got[3]["formatted_chars"] > 300000
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_content(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "a", 28, 28, None, None), ("text", "hi", None, None, None, None, None)])], f"conv_id long, turn long, role string, content {chat.CONTENT}")
    row = chat.format_conversations(df).first()
    assert row["attachments"][0]["uri"] == "a" and row["formatted"] == "<s>[ROLE user]\n<|image|>hi</s>\n"


def test_odd_parts(spark):
    nan = float("nan")
    content = [None, (None, "plain", None, None, None, None, None), ("video", "x", "v", None, None, None, None), ("audio", None, None, None, None, nan, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None), (None, 0, "user", content[1:2]), (None, 0, "user", content[1:2])], f"conv_id long, turn long, role string, content {chat.CONTENT}")
    rows = chat.format_conversations(df).collect()
    row = next(r for r in rows if r["conv_id"] == 1)
    assert row["formatted"] == "<s>[ROLE user]\nplain<|other|><|audio|></s>\n<s>[ROLE assistant]\n</s>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in row["attachments"]] == [("other", "v", 1), ("audio", "", 1)]
    assert [r["n_turns"] for r in rows if r["conv_id"] is None] == [1, 1]
    assert next(r for r in chat.read_back(chat.format_conversations(df)).collect() if r["conv_id"] == 1)["n_turns"] == 2


def test_query_equals_sql(spark, tmp_path):
    """The query's rows equal its SQL, control characters, nulls, ties and rows without an id included."""
    import duckdb

    from lodestrand.llm import queries

    rows = [(1, 0, "user", "a\\b]c[d|e<f>g"), (1, 1, "assistant", "\\0\\"), (1, 1, "assistant", "\\0\\"), (1, None, None, None), (2, 0, "assistant", "\u00e9\U0001f600\n"), (None, 0, "user", "x"), (None, 0, "assistant", "x"), (3, 0, "]\n</s>", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_chat_parts"])
    got = queries.QUERIES["op9_chat_parts"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
