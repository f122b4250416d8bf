import json

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import catalog, filters, matching, render, rewrite
from lodestrand.plans import catalog as plans
from lodestrand.plans import standins

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def meetings(spark):
    rows = [("m1", "2025-11-04T10:00:00+08:00", ["Ann", "Bo"], ["x"], ["t"]), ("m2", None, ["Bo"], [], []), ("m3", "2024-04-14T09:00:00Z", [], ["y", "z"], []), ("m4", "2025-11-04T08:00:00Z", ["Cy"], [], [])]
    return catalog.flatten(spark.createDataFrame(rows, "meeting_id string, datetime string, participants array<string>, topics array<string>, action_tasks array<string>"))


def ids(df):
    return [r["meeting_id"] for r in df.collect()]


def test_last_n(meetings):
    assert ids(catalog.last_n(meetings, 2)) == ["m1", "m4"]
    assert ids(catalog.last_n(meetings, 99)) == ["m1", "m4", "m3", "m2"]
    assert len(ids(catalog.last_n(meetings, 0))) == 3
    assert ids(catalog.last_n(meetings, 5, "Bo")) == ["m1", "m2"]
    assert ids(catalog.last_n(meetings, 5, "Nobody")) == []


def test_undated_meetings_pass_an_end_only(meetings):
    assert set(ids(catalog.by_date_range(meetings, end="2024-12-31"))) == {"m2", "m3"}
    assert set(ids(catalog.by_date_range(meetings, start="2024-04-14"))) == {"m1", "m3", "m4"}
    assert ids(catalog.by_date_range(meetings, "2024-04-14", "2024-04-14")) == ["m3"]


def test_year_month_and_dispatch(meetings):
    assert set(ids(catalog.by_year_month(meetings, 2025, 0))) == {"m1", "m4"}
    assert len(ids(catalog.by_year_month(meetings, 0, 0))) == 4
    assert {r[0] for r in catalog.query(meetings, "all_participants").collect()} == {"Ann", "Bo", "Cy"}
    with pytest.raises(ValueError):
        catalog.query(meetings, "drop_everything")


@pytest.mark.parametrize("name, candidate, score", [("Robins", "Robins Hale", 70.59), ("Hale", "Robins Hale", 53.33), ("Mirko", "Mirko Adler", 62.50), ("hale robins", "Robins Hale", 100.0), ("", "Robins Hale", 0.0), ("", "", 0.0)])
def test_name_similarity(name, candidate, score):
    assert matching.ratio(name, candidate) == pytest.approx(score, abs=0.005)


def test_matches_above_the_threshold(spark):
    names = spark.createDataFrame([("Robins",), ("Hale",), ("hale robins",)], "name string")
    known = spark.createDataFrame([("Robins Hale",), ("Mirko Adler",)], "candidate string")
    assert {r["name"]: r["candidate"] for r in matching.best_match(names, known).collect()} == {"Robins": "Robins Hale", "Hale": None, "hale robins": "Robins Hale"}
    assert matching.matches(names, known, threshold=0.0).count() == 6


def resolved(spark, text):
    questions = spark.createDataFrame([(1, text)], "question_id int, text string")
    people = F.array(F.lit("Robins Hale"), F.lit("Speaker 1"))
    return rewrite.resolve(rewrite.detect(questions, people), "Ann", "2024-05-15").first()["resolved"]


def test_substitution(spark):
    assert resolved(spark, "I met Robins yesterday") == "Ann met Robins Hale 2024-05-14"
    assert resolved(spark, "Did Robins Hale call us?") == "Did Robins Hale call Ann?"
    assert resolved(spark, "Inside the last meeting") == "Inside the last meeting"


def test_latest_meetings(spark, meetings):
    asked = spark.createDataFrame(list(enumerate(["last meeting?", "recent meetings", "last 2 meetings", "meeting"])), "question_id int, text string")
    found = {r["question_id"]: (r["n"], r["relevant_meeting_ids"]) for r in rewrite.rewrite_latest(asked, meetings).collect()}
    assert found == {0: (1, "m1"), 1: (3, "m1, m4, m3"), 2: (2, "m1, m4"), 3: (None, "")}


def test_plan(spark):
    asked = spark.createDataFrame([(1, "What is a monad?"), (2, "What is our minutes format?"), (3, "hm")], "question_id int, text string")
    flags = {r["question_id"]: (r["need_rag"], r["need_rewrite"], r["answer_mode"]) for r in rewrite.plan(asked).collect()}
    assert flags == {1: (False, False, "direct"), 2: (True, True, "rag"), 3: (True, False, "rag")}


def test_nested_filters(spark):
    person = "struct<name:string,aliases:array<string>>"
    rows = [(1, [("send the report", "open", ("Ann", ["A", "Annie"]))], ["x"]), (2, [("call", "done", ("Bo", []))], ["y", "z"]), (3, None, None)]
    docs = spark.createDataFrame(rows, f"id int, actions array<struct<task:string,status:string,assignee:{person}>>, topics array<string>")

    def found(**wanted):
        return [r["id"] for r in docs.filter(filters.compile(docs, {k.replace("__", "."): v for k, v in wanted.items()})).orderBy("id").collect()]

    assert found(actions__assignee__aliases="Annie") == [1]
    assert found(actions__task="REPORT call") == [1, 2]
    assert found(actions__status=["open", "lost"], topics="x") == [1]
    assert found(topics=["z", "x"]) == [1, 2]
    assert found() == [1, 2, 3]
    with pytest.raises(ValueError):
        found(actions__nothing="x")


def test_rendering(spark):
    hits = spark.createDataFrame([(1, 2, "c2", None, "Two. More"), (1, 1, "c1", "2024-01-01", "One! x")], "query_id int, rank int, chunk_id string, datetime string, text string")
    assert render.contexts(hits, 15).first()["context"] == "[c1] (Date: 2024-01-01)\nOne! x\n\n[c2] (Date: None)\nTwo. More\n"
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r["query_id"]: r["answer"] for r in render.answers(queries, hits).collect()} == {1: "One! [c1]\nTwo. [c2]", 2: render.NOTHING}
    shown = {r["query_id"]: (r["n_chunks"], r["context"]) for r in render.with_empty(queries, render.contexts(hits)).collect()}
    assert shown[1][0] == 2 and shown[2] == (0, "No relevant context found.")


def test_outlines(spark):
    rows = spark.createDataFrame([(1, "Plans", [("A", [("x",), ("y",)]), ("B", []), ("C", [("z",)])]), (2, "None", [])], "id int, topic string, parts array<struct<topic_name:string,bullet_points:array<struct<point:string>>>>")
    got = {r["id"]: r["t"] for r in rows.select("id", render.outline(F.col("topic"), F.col("parts")).alias("t")).collect()}
    assert got == {1: "Discussion on Plans\n\n- A\n  - x\n  - y\n\n- B\n\n- C\n  - z", 2: "Discussion on None"}


def test_answers_by_day(spark):
    hits = [(1, 1, "a", "2024-05-03T10:00:00Z", "One. x"), (1, 2, "b", "2024-05-04", "Two! x"), (1, 3, "c", "2024-05-03", "Three"), (1, 4, "d", None, "Four"), (2, 1, "a", "2024-05-03", "One. x")]
    hits = spark.createDataFrame(hits, "query_id int, rank int, chunk_id string, datetime string, text string")
    asked = spark.createDataFrame([(1, "on 2024-05-04, 2024-05-03, 2024-05-04 or 2024-05-09?"), (2, "any day"), (3, "on 2024-05-04")], "query_id int, text string")
    got = {r["query_id"]: r["answer"] for r in render.dated_answers(asked, hits).collect()}
    assert got[1] == "2024-05-04:\nTwo! [b]\n\n2024-05-03:\nOne. [a]\nThree [c]\n\nNo information is available for 2024-05-09."
    assert got[2] == "One. [a]" and got[3] == render.NOTHING


CALL = "call_id int, query_type string, n int, person_name string, fuzzy_name string, date_str string, year int, month int, start_date string, end_date string"


def test_catalog_calls(spark, meetings):
    def call(i, kind, **given):
        return (i, kind, *[given.get(c.split()[0]) for c in CALL.split(", ")[2:]])

    calls = [
        call(1, "last_n_meetings", n=2),
        call(2, "last_n_meetings", n=0, person_name="Ann"),
        call(3, "date_from_relative", date_str="yesterday"),
        call(4, "date_from_relative", date_str="one day"),
        call(5, "filter_by_person", fuzzy_name="Ann"),
        call(6, "filter_by_person"),
        call(7, "filter_by_date"),
        call(8, "filter_by_date_range"),
        call(9, "get_all_participants"),
        call(10, "find_person", fuzzy_name="An"),
        call(11, "nothing"),
        call(12, None),
        call(13, "filter_by_date_range", end_date="2024-12-31"),
    ]
    frame = spark.createDataFrame(calls, CALL)
    rows = catalog.tool_rows(frame, meetings, "2024-05-15").collect()
    got = {i: [r for r in sorted(rows, key=lambda r: r["place"] or 0) if r["call_id"] == i] for i in range(1, 14)}
    assert [r["meeting_id"] for r in got[1]] == ids(catalog.last_n(meetings, 2))
    assert [r["meeting_id"] for r in got[2]] == ids(catalog.last_n(meetings, 0, "Ann"))
    assert [r["date"] for r in got[3]] == ["2024-05-14"] and [r["date"] for r in got[4]] == [None]
    assert sorted(r["meeting_id"] for r in got[5]) == sorted(ids(catalog.by_person(meetings, "Ann")))
    assert got[6][0]["error"] == "fuzzy_name is required" and got[8][0]["error"].startswith("At least one")
    assert len(got[7]) == meetings.count() and [r["date"] for r in got[7]] == sorted((r["date"] for r in got[7]), reverse=True)
    assert [r["name"] for r in got[9]] == sorted(r["participant"] for r in catalog.participants(meetings).collect())
    assert [(r["place"], r["name"], r["score"]) for r in got[10]] == [(r["rank"], r["candidate"], r["score"]) for r in matching.find_person(meetings, "An").orderBy("rank").collect()]
    assert got[11][0]["error"] == "Unknown query_type: nothing" and got[12][0]["error"] == "Unknown query_type: null"
    assert sorted(r["meeting_id"] for r in got[13]) == sorted(ids(catalog.by_date_range(meetings, None, "2024-12-31")))
    results = {r["call_id"]: (r["count"], json.loads(r["result"])) for r in catalog.tool_results(frame, meetings, "2024-05-15").collect()}
    assert set(results) == set(range(1, 14)) and results[1][1]["meeting_ids"] == [r["meeting_id"] for r in got[1]]
    assert results[6] == (0, {"query_type": "filter_by_person", "meeting_ids": [], "dates": [], "names": [], "scores": [], "count": 0, "error": "fuzzy_name is required"})
    assert catalog.tool_rows(frame.limit(0), meetings, "2024-05-15").count() == 0


def test_lines_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    lines = standins.read(spark, SF, "lineitem").count()
    monkeypatch.setattr(standins, "LINES", 100)
    assert f"{-(-lines // 100)}), REPARTITION_BY_NUM" in plan_of(standins.meetings(spark, SF))


def test_a_range_of_dates_reads_the_catalog_once(spark):
    plan = plan_of(plans.QUERIES["q34_filter_by_date_range"](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_years_and_months_read_the_catalog_once(spark):
    plan = plan_of(plans.QUERIES["q35_filter_by_year_month"](spark, SF))
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_calls_share_one_catalog_and_the_ranks_of_days(spark):
    """The catalog is computed once for all types of calls, and places go on from day to day."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, f"2024-0{1 + i % 3}-0{1 + i % 2}" if i % 5 else None, ["Ada"]) for i in range(40)]
    base = spark.createDataFrame(rows, "meeting_id long, date string, participants array<string>")
    base = base.select("meeting_id", "date", F.substring("date", 1, 4).cast("int").alias("year"), F.substring("date", 6, 2).cast("int").alias("month"), "participants")
    counting = base.mapInArrow(counted, base.schema)
    fields = "call_id long, query_type string, n int, person_name string, fuzzy_name string, date_str string, year int, month int, start_date string, end_date string"
    calls = [(1, "filter_by_date", None, None, None, None, 2024, None, None, None), (2, "filter_by_date", None, None, None, None, None, None, None, None)]
    calls += [(3, "filter_by_date_range", None, None, None, None, None, None, "2024-01-02", "2024-02-02"), (4, "get_all_participants", None, None, None, None, None, None, None, None), (5, "last_n_meetings", 2, None, None, None, None, None, None, None)]
    found = catalog.tool_rows(spark.createDataFrame(calls, fields), counting, "2024-05-15").collect()
    assert seen.value == len(rows)
    latest = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))
    fits = {1: lambda d: d is not None, 2: lambda d: True, 3: lambda d: d is not None and "2024-01-02" <= d <= "2024-02-02"}
    for call, fit in fits.items():
        got = [(r["place"], r["meeting_id"]) for r in sorted((r for r in found if r["call_id"] == call), key=lambda r: r["place"])]
        assert got == [(i + 1, r[0]) for i, r in enumerate(x for x in latest if fit(x[1]))]
