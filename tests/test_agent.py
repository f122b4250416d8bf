import json

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import agent, evaluate, matching, models, rewrite
from lodestrand.settings import Settings
from lodestrand.sources import meetings as source

PEOPLE = ["Ada Lovelace", "Grace Hopper", "Host"]
ASKED = "question_id long, text string, embedding array<float>"


@pytest.fixture
def people():
    return F.array(*map(F.lit, PEOPLE))


@pytest.fixture
def catalog(spark):
    rows = [("m1", "2024-05-01", ["Ada Lovelace"]), ("m2", "2024-05-02", ["Grace Hopper"]), ("m3", "2024-05-03", ["Ada Lovelace", "Grace Hopper"]), ("m4", "", ["Ada Lovelace"])]
    return spark.createDataFrame(rows, "meeting_id string, date string, participants array<string>")


@pytest.fixture
def chunks(spark):
    rows = [(f"m{i}_summary_{j}", f"m{i}", f"budget point {i} {j}. More.", [1.0, float(i)], None if i == 4 else f"2024-05-0{i}") for i in range(1, 5) for j in range(3)]
    return spark.createDataFrame(rows, "chunk_id string, meeting_id string, text string, embedding array<float>, datetime string")


def test_the_person_asked_for_limits_the_latest_meetings(spark, catalog, people):
    asked = spark.createDataFrame([(1, "What did Grace say in the last 2 meetings?"), (2, "Summarise the last meeting"), (3, "my notes of recent meetings"), (4, "no phrase")], "question_id long, text string")
    got = {r["question_id"]: (r["rewritten"], r["meeting_ids"]) for r in agent.rewrite_queries(asked, catalog, people, "Ada Lovelace", "2024-05-15").collect()}
    assert got[1] == ("What did Grace Hopper say in the meetings m3, m2?", ["m3", "m2"])
    assert got[2] == ("Summarise the meetings m3", ["m3"])
    assert got[3] == ("Ada Lovelace notes of meetings m3, m1, m4", ["m3", "m1", "m4"])
    assert got[4] == ("no phrase", [])


def test_questions_to_answers(spark, catalog, chunks, people):
    rows = [(1, "What was the budget in the last meeting?", [1.0, 0.0]), (2, "Define budget", [1.0, 0.0]), (3, "Which meetings had a budget?", [0.0, 1.0]), (4, "Grace in the last 9 meetings", [0.0, 1.0])]
    got = {r["question_id"]: r for r in agent.ask(spark.createDataFrame(rows, ASKED), chunks, catalog, people, "Ada Lovelace", "2024-05-15", k=4).collect()}
    assert got[1]["meeting_ids"] == ["m3"] and [c["chunk_id"] for c in got[1]["chunks"]] == ["m3_summary_0", "m3_summary_1", "m3_summary_2"]
    assert got[1]["answer"].splitlines()[0] == "budget point 3 0. [m3_summary_0]" and got[1]["chunks"][0]["datetime"] == "2024-05-03"
    assert got[2]["skipped"] and got[2]["chunks"] is None and got[2]["total_chunks"] == 0 and got[2]["answer_mode"] == "direct"
    assert got[3]["total_chunks"] == 4 and not got[3]["need_rewrite"]
    assert {c["chunk_id"][:2] for c in got[4]["chunks"]} <= {"m2", "m3"}


def test_a_golden_set_is_run(spark, catalog, chunks, people):
    embedder = models.HashingEmbedder(2)
    golden = spark.createDataFrame([("g1", "What was the budget in the last meeting?", "budget point 3", ["m3", "m1"], ["x"]), ("g2", "Define x", "x", [], [])], "id string, question string, ground_truth string, relevant_meeting_ids array<string>, expected_topics array<string>")

    def broken(question, answer, truth, contexts):
        raise RuntimeError("no judge")

    scores, total = evaluate.run(golden, lambda q: agent.ask(q, chunks, catalog, people, "Ada", "2024-05-15", embedder), evaluate.WORD_JUDGES | {"tone": broken})
    got = {r["id"]: r for r in scores.collect()}
    assert got["g1"]["meeting_recall"] == 0.5 and got["g1"]["context_recall"] == 1.0 and got["g1"]["tone"] is None and "no judge" in got["g1"]["error"]
    assert got["g2"]["meeting_recall"] is None and got["g2"]["faithfulness"] is not None
    done = total.first()
    assert done["total_cases"] == 2 and done["successful_cases"] == 0 and done["context_recall"] == 0.5


def test_what_pronouns_and_parts_of_names_stand_for(spark):
    asked = spark.createDataFrame([(1, "Did she tell me of Hopper?")], "question_id long, text string")
    both = rewrite.ambiguity(asked, F.array(F.lit("Ada Lovelace"), F.lit("Grace Hopper")), "Robin").first()
    assert both["is_ambiguous"] and [tuple(m) for m in both["mapping"]] == [("she", None), ("me", "Robin"), ("Grace Hopper", "Grace Hopper")]
    one = rewrite.ambiguity(asked, F.array(F.lit("Host"), F.lit("Grace Hopper")), "Robin").first()
    assert one["mapping"][0]["meaning"] == "Grace Hopper"
    assert spark.range(1).select(matching.resolve_pronoun(F.array(F.lit("A"))).alias("x")).first()["x"] == "A"
    assert spark.range(1).select(matching.resolve_pronoun(F.array(F.lit("A"), F.lit("B"))).alias("x")).first()["x"] is None


def test_names_are_detected_and_resolved(spark):
    texts = spark.createDataFrame([(1, "What about hongye and the weather"), (2, "Hongy"), (3, None), (4, "Mr Lovelase spoke"), (5, "the host")], "i int, text string")
    people = ["Hongye Qian", "Ada Lovelace", "Host"]
    got = {r["i"]: (r["detected"], r["resolved"]) for r in matching.detect_and_resolve(texts, people).collect()}
    assert got == {1: (["Hongye Qian"], ["Hongye Qian"]), 2: (["Hongye Qian"], ["Hongye Qian"]), 3: ([], []), 4: ([], []), 5: ([], [])}
    named = matching.detect_and_resolve(texts, people, lambda t: ["Lovelase Ada"] if "Lovelase" in t else ["Nobody"])
    got = {r["i"]: (r["detected"], r["resolved"]) for r in named.collect()}
    assert got[4] == (["Lovelase Ada"], ["Ada Lovelace"]) and got[5] == (["Nobody"], [])


def test_set_ratio():
    assert matching.set_ratio("qian", "who is Qian here") == 100.0
    assert matching.set_ratio("", "x") == matching.set_ratio(None, "x") == 0.0
    assert matching.set_ratio("hongye", "hongy") == pytest.approx(2 * 5 / 11 * 100)
    assert matching.set_ratio("a b c", "a b d") == pytest.approx(100 * 2 * 4 / 10)


def test_matches_equal_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(matching, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(matching, "NAME_BLOCK", 7)
    own = random.Random(2)
    word = lambda: "".join(own.choice("abcdé") for _ in range(own.randrange(1, 7)))
    people = sorted({f"{word()} {word()}" for _ in range(70)})
    names = sorted({f"{word()} {word()}" for _ in range(30)} | {"", "?"})
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = {(r["name"], r["rank"]): (r["candidate"], r["score"]) for r in matching.matches(df(names, "name"), df([*people, None], "candidate"), 3, 0.6).collect()}
    want = {}
    for n in names:
        best = sorted((-round(matching.ratio(n, p), 6), p) for p in people)[:3]
        want |= {(n, i + 1): (p, -s) for i, (s, p) in enumerate(best) if -s >= 60}
    assert got == want and len(want) > 20


def test_find_person(catalog):
    assert [r["candidate"] for r in matching.find_person(catalog, "grace hoper").collect()] == ["Grace Hopper"]
    assert matching.find_person(catalog, "zzz").count() == 0


def test_settings(tmp_path):
    path = tmp_path / "env"
    path.write_text("# x\nLODESTRAND_CHUNK_SIZE=100\nLODESTRAND_MODEL = 'm'\nOTHER=1\n")
    made = Settings.read(str(path), {"LODESTRAND_CHUNK_SIZE": "50", "LODESTRAND_ONLY_SUMMARY": "no"})
    assert (made.chunk_size, made.model, made.only_summary, made.top_k_chunk) == (50, "m", False, 5)
    assert Settings.read(str(tmp_path / "none"), {}) == Settings()
    with pytest.raises(ValueError):
        Settings.read(env={"LODESTRAND_CHUNK_SIZE": "many"})


def Says(answer):
    class Fixed:
        def generate(self, prompt):
            return answer

    return Fixed()


def test_six_documents_are_checked(spark):
    outline = {"high_level_topic": "t", "second_level_topics": [{"topic_name": "a", "bullet_points": [{"point": "p"}]}]}
    rows = spark.createDataFrame([(1, "text")], "file_num int, text string")
    good = models.generate_task(rows, "outline", Says("no json"), Says(f"```json\n{json.dumps(outline)}\n```")).first()
    assert json.loads(good["generated"]) == outline and good["error"] is None
    del outline["second_level_topics"][0]["bullet_points"]
    bad = models.generate_task(rows, "outline", Says(json.dumps(outline))).first()
    assert bad["generated"] is None and "bullet_points" in bad["error"]
    texts = {"transcript": "[#P001] [00:01] **A:** hi", "meeting_level": "## Key Topics", "summary": "- **[S001-T01] Topic: x**", "report": "## A\ntext"}
    for task, text in texts.items():
        assert models.generate_task(rows, task, Says(text)).first()["generated"] == text
        assert models.generate_task(rows, task, Says("nothing of it")).first()["generated"] is None
    about = {"meeting_id": "m", "title": "t", "participants": [{"name": "A"}], "topics": [], "actions": []}
    assert models.generate_task(rows, "metadata", Says(json.dumps(about))).first()["error"] is None
    assert "title" in models.generate_task(rows, "metadata", Says('{"meeting_id": 1}')).first()["error"]
    assert set(models.TASKS) == {*texts, "outline", "metadata"}
    with pytest.raises(ValueError):
        models.generate_task(rows, "poem", Says(""))


def test_levels_have_embedders_of_their_own(spark):
    chunks = spark.createDataFrame([(1, "summary", "a b"), (2, "meeting", "a b"), (3, "chunk", "a b"), (4, None, "x")], "chunk_id int, level string, text string")
    got = {r["chunk_id"]: r["embedding"] for r in models.embed_levels(chunks, {"summary": models.HashingEmbedder(4), "meeting": models.HashingEmbedder(6)}).collect()}
    assert len(got[1]) == 4 and len(got[2]) == 6 and got[3] is None and got[4] is None
    assert models.dimension_of("openai/text-embedding-3-large") == 3072 and models.dimension_of("own", models.HashingEmbedder(9)) == 9
    with pytest.raises(ValueError):
        models.dimension_of("own")


def test_files_that_are_missing_are_listed(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"con{n}").mkdir()
        about = {"meeting_id": f"data00{n}", "related_files": {"transcript": f"data00{n}.md", "meeting_summary": "gone.md", "summary_embedding": f"data00{n}.md"}}
        (tmp_path / f"con{n}" / f"metaData00{n}.json").write_text(json.dumps(about) if n == 1 else "{")
        (tmp_path / f"con{n}" / f"data00{n}.md").write_text("x")
    got = sorted(map(tuple, source.problems(spark, str(tmp_path)).collect()))
    assert got == [("con1", "gone.md", "no file for meeting_level_text"), ("con2", "metaData002.json", "unreadable metadata")]
    files = spark.createDataFrame([("k", "b", " "), ("k", "a", None), ("m", "a", "x")], "key string, path string, text string")
    assert sorted(map(tuple, source.stitched(files, "key").collect())) == [("k", None, "all files are empty"), ("m", "x", None)]


def test_pairs_and_what_is_on_one_side_only(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(2, "p"), (2, "q"), (3, "r")], "k int, y string")
    both, only = source.paired(left, right, "k")
    assert sorted(map(tuple, both.collect())) == [(2, "b", "p"), (2, "b", "q")]
    assert sorted(map(tuple, only.collect()), key=str) == [(1, "left"), (3, "right"), (None, "left")]
