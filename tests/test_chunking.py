import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.operators import chunking


def test_bullets_are_packed_with_the_last_one_carried_over():
    assert chunking.pack_bullets("- aaaa\n- bbbb\n- cccc", 12) == ["- aaaa\n- bbbb", "- bbbb\n- cccc"]


def test_one_long_bullet_and_the_carried_one_may_pass_the_limit():
    long = "- " + "x" * 50
    assert chunking.pack_bullets(long + "\n- b", 20) == [long, long + "\n- b"]


def test_without_bullets_the_text_is_one_chunk():
    assert chunking.pack_bullets("a\nb", 1) == ["a\nb"]
    assert chunking.pack_bullets(" \n", 10) == [] and chunking.pack_bullets(None, 10) == [] and chunking.pack_bullets("", 10) == []


def test_lines_below_a_bullet_stay_with_it():
    assert chunking.pack_bullets("intro\n- a\n  more\n- b", 100) == ["intro\n- a\n  more\n- b"]
    assert chunking.pack_bullets("intro\n- aaaa\n  more\n- b", 14) == ["intro", "- aaaa\n  more", "- aaaa\n  more\n- b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab -\n", max_size=12), max_size=12), st.integers(1, 40))
def test_every_bullet_appears_in_some_chunk(lines, limit):
    text = "\n".join(lines)
    chunks = chunking.pack_bullets(text, limit)
    for line in text.split("\n"):
        if line.strip().startswith("- "):
            assert any(line in c for c in chunks)


@settings(max_examples=60, deadline=None)
@given(st.text("abc \n，", max_size=300), st.integers(5, 40))
def test_recursive_pieces_keep_to_the_size(text, size):
    pieces = chunking.split_recursively(text, size, size // 4)
    assert all(0 < len(p) <= size for p in pieces)
    assert set("".join(pieces)) - set(" \n，") == set(text) - set(" \n，")


def test_paragraph_numbers(spark):
    text = "# head\n\nfirst\nstill\n\n[#P009] [00:01] said\n\n## x\nafter heading\n\n  \nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = chunking.paragraph_index(chunking.lines(docs, "id"), "id")
    starts = [(r["line"], r["paragraph"]) for r in rows.filter("is_start").orderBy("id", "line_no").collect()]
    assert starts == [("first", 1), ("last", 2)]
    tagged = {r["id"]: r["text"] for r in chunking.tagged(rows, "id").collect()}
    assert tagged[1].split("\n")[2] == "[#P001] first" and tagged[3] == "" and 2 not in tagged
    assert [(r["line_no"], r["paragraph"]) for r in rows.filter("id = 1").orderBy("line_no").collect()] == [(i, int(i >= 2) + int(i >= 11)) for i in range(12)]


def test_sections_and_entries_do_not_move(spark):
    docs = spark.range(3).selectExpr("id", "'## a\n- **Topic Title:** b\n\nc' as text")
    for made in (chunking.entries(docs, "id"), chunking.sections(docs, "id")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def plain_sections(text):
    """Sections line by line."""
    out, number, name = {}, 0, "Unknown"
    for line in filter(None, (row.strip(" \n\r\t") for row in text.split("\n"))):
        if re.match(r"##\s+[^\n]+", line):
            number, name = number + 1, re.sub(r"^##\s+", "", line).strip(" \n\r\t")
        else:
            out.setdefault((number, name), []).append(line)
    return sorted((k, n, "  \n".join(lines)) for (k, n), lines in out.items())


def plain_entries(text):
    """Entries line by line."""
    out = []
    for i, row in enumerate(text.split("\n")):
        if i == 0 or re.match(r"-\s*\*\*(Topic Title|Responsible Person):\*\*", row.strip(" \n\r\t")):
            out.append([])
        out[-1].append(row)
    return [(i + 1, "\n".join(rows)) for i, rows in enumerate(out)]


def test_sections_and_entries_equal_plain_ones(spark):
    pieces = ["## a", "##", "## ", "##\tb ", " ## c", "x", "", "  ", "\r", "### d", "- **Topic Title:** t", "\t-  **Responsible Person:** p", "-\x0b**Topic Title:**", "- ** Topic Title:**", "##\x0b", "##\x0b\x0b"]
    pick = random.Random(5)
    texts = ["", "\n", *pieces, *("\n".join(pick.choices(pieces, k=pick.randrange(1, 9))) for _ in range(300))]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    found = {"sections": {}, "entries": {}}
    for r in chunking.sections(docs, "id").collect():
        found["sections"].setdefault(r["id"], []).append((r["section_no"], r["section"], r["body"]))
    for r in chunking.entries(docs, "id").collect():
        found["entries"].setdefault(r["id"], []).append((r["entry_no"], r["entry"]))
    assert -1 not in found["sections"] and -1 not in found["entries"]
    for i, text in enumerate(texts):
        assert sorted(found["sections"].get(i, [])) == plain_sections(text), text
        assert sorted(found["entries"][i]) == plain_entries(text), text


def meeting(spark):
    level = "# H1\n## Key Topics\n- **Topic Title:** A\n  - Topic id: M001-T01\n  - Reference: P002-P001\n" + "- more " + "x" * 1300 + "\n## Action Items\n- **Responsible Person:** Bo\n  - Action id: M001-A01"
    row = ("data001", "Talk", None, "Brief", level, "- [S001-T01] Topic: A\n  Reference: M001-T01", "one\n\ntwo", [("A01", "do it"), ("A02", ""), ("A03", None)])
    return spark.createDataFrame([row], "meeting_id string, title string, datetime string, summary_brief string, meeting_level_text string, summary_text string, conversation_text string, actions array<struct<action_id:string,description_plain:string>>")


def test_levels(spark):
    rows = chunking.all_levels(meeting(spark), include_chunk_level=True).collect()
    by_level = {}
    for r in rows:
        by_level.setdefault(r["level"], []).append(r)
    assert set(by_level) == {"metadata", "summary", "meeting", "chunk"}
    assert by_level["metadata"][0]["text"] == "Brief Summary: Brief\ndo it"
    summary = by_level["summary"][0]
    assert summary["chunk_id"] == "data001_summary_0" and summary["references"] == ["M001-T01"] and summary["text"].endswith("\n\nMeeting: Talk\nDate: None")
    entries = sorted(by_level["meeting"], key=lambda r: r["chunk_id"])
    assert [r["section"] for r in entries] == ["Unknown", "Key Topics", "Key Topics", "Action Items"]
    assert entries[1]["entry_id"] == entries[2]["entry_id"] == "M001-T01"
    assert entries[2]["paragraph_indices"] == ["#P001", "#P002"]
    assert {r["level"] for r in chunking.all_levels(meeting(spark), only_summary=True).collect()} == {"summary"}


def plain_split(text, size, overlap, marks=("\n\n", "\n", "；", "，", " ", "")):
    """split_recursively by lengths of joined lists."""
    if not text or not text.strip():
        return []
    mark = next((m for m in marks if m == "" or m in text), "")
    finer = marks[marks.index(mark) + 1 :] if mark else ()
    out, held = [], []

    def flush():
        if held and mark.join(held).strip():
            out.append(mark.join(held).strip())

    for part in [p for p in (text.split(mark) if mark else list(text)) if p]:
        if len(part) > size and finer:
            flush()
            held = []
            out += plain_split(part, size, overlap, finer)
            continue
        if held and len(mark.join([*held, part])) > size:
            flush()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held = held[1:]
        held = [*held, part]
    flush()
    return out


def test_splitting_equals_the_plain_way():
    import random

    own = random.Random(7)
    for _ in range(300):
        text = "".join(own.choice(["ab", "c", " ", "\n", "\n\n", "；", "，", "é"]) for _ in range(own.randrange(120)))
        size = own.randrange(1, 30)
        assert chunking.split_recursively(text, size, own.randrange(0, size + 1) // 2) is not None
        assert chunking.split_recursively(text, size, size // 3) == plain_split(text, size, size // 3)


def test_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    chunking.pack_bullets("\n".join(f"- b{i}" for i in range(100_000)))
    chunking.split_recursively("w " * 300_000)
    assert time.perf_counter() - began < 10


def test_tags_stand_behind_the_indentation(spark):
    docs = spark.createDataFrame([(1, "  one\n\n\ttwo\nmore")], "id int, text string")
    rows = chunking.paragraph_index(chunking.lines(docs, "id"), "id")
    assert chunking.tagged(rows, "id").first()["text"] == "  [#P001] one\n\n [#P002] two\nmore"


def test_metadata_without_a_brief(spark):
    rows = spark.createDataFrame([(1, None, ["a", "", None]), (2, "", []), (3, "b", ["c"])], "id int, brief string, said array<string>")
    got = {r["id"]: r["text"] for r in rows.select("id", chunking.metadata_text(F.col("brief"), F.col("said")).alias("text")).collect()}
    assert got == {1: "a", 2: "", 3: "Brief Summary: b\nc"}
