import json

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import chunking, models
from lodestrand.sources import index
from lodestrand.sources import meetings as source
from lodestrand.streaming import incremental


@pytest.fixture
def root(tmp_path):
    for n, when in ((1, "2025-11-04T10:00:00+08:00"), (2, None)):
        folder = tmp_path / f"con{n}"
        folder.mkdir()
        about = {
            "meeting_id": f"data00{n}",
            "title": "Talk",
            "datetime": when,
            "participants": [{"name": "Ann ", "role": "lead", "aliases": []}, {"name": "Bo", "role": None, "aliases": []}],
            "topics": ["old"],
            "actions": [{"action_id": "X1", "description_plain": "write", "assignee": {"name": "Cy"}}],
            "summary_brief": "b",
            "related_files": {"transcript": f"data00{n}.md", "meeting_summary": f"MEETLEVEL00{n}.md", "summary_embedding": f"summary00{n}.md"},
        }
        (folder / f"metaData00{n}.json").write_text(json.dumps(about))
        (folder / f"data00{n}.md").write_text("# d\n\n[#P001] [00:01] **Ann:** hi\n")
        (folder / f"meetLevel00{n}.md").write_text("## Key Topics\n- **Topic Title:** A\n  - Topic id: M001-T01\n")
        (folder / f"summary00{n}.md").write_text("- **[S001-T01] Topic: A**\n- **[S001-A01] Action: Ann to write it**\n- **[S001-A02] Action: rest**" if n == 1 else "none")
    bad = tmp_path / "con9"
    bad.mkdir()
    (bad / "metaData009.json").write_text("{ not json")
    return str(tmp_path)


def test_meetings_are_assembled_and_bad_files_left_out(spark, root):
    found = {r["meeting_id"]: r for r in source.load(spark, root).collect()}
    assert set(found) == {"data001", "data002"}
    assert found["data001"]["meeting_level_text"].startswith("## Key Topics") and found["data002"]["datetime"] is None


def test_summary_metadata(spark, root):
    found = {r["meeting_id"]: r for r in source.summary_metadata(source.load(spark, root)).collect()}
    one = found["data001"]
    assert one["topics"] == ["A"] and one["participants"] == ["Ann", "Bo"]
    assert [tuple(a) for a in one["actions"]] == [("X1", "Ann to write it", "Ann"), ("M001-A02", "rest", None)]
    assert found["data002"]["topics"] == ["old"] and found["data002"]["actions"] == []


def test_numbered_and_stitched_files(spark, root):
    assert [r["file_num"] for r in source.numbered_files(spark, root, "data*.md", 2, 5).collect()] == [2]
    files = spark.createDataFrame([("k", "b", " two "), ("k", "a", "one"), ("k", "c", " ")], "key string, path string, text string")
    assert source.stitched(files, "key").first()["text"] == "one\n\ntwo"


def test_golden_set(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"test_cases": [{"id": "q1", "question": "?", "ground_truth": "!", "relevant_meeting_ids": ["data001"], "expected_topics": []}]}))
    assert source.golden(spark, str(path)).first()["relevant_meeting_ids"] == ["data001"]


def test_index_round_trip_and_upsert(spark, root, tmp_path):
    path = str(tmp_path / "index")
    chunks = models.embed(chunking.all_levels(source.load(spark, root)), models.HashingEmbedder(8))
    index.save(chunks, path, 8)
    loaded = index.load(spark, path, 8)
    assert loaded.count() == chunks.count()
    with pytest.raises(ValueError):
        index.load(spark, path, 9)
    assert index.unseen(spark.createDataFrame([("data001",), ("new",)], "meeting_id string"), loaded).collect()[0][0] == "new"
    changed = loaded.filter("level = 'metadata'").withColumn("text", F.lit("changed"))
    both = index.upsert(loaded, changed)
    assert both.count() == loaded.count() and both.filter("text = 'changed'").count() == 2
    kept = {r["level"]: r["n_chunks"] for r in index.stats(index.without_levels(loaded, "metadata"), list(index.LEVELS)).collect()}
    assert kept["metadata"] == 0 and kept["summary"] == 2
    index.drop(spark, path, "summary")
    assert spark.read.parquet(f"{path}/chunks").filter("level = 'summary'").count() == 0
    assert index.health(spark, str(tmp_path / "nothing"))["status"] == "missing"
    assert index.load_or_empty(spark, str(tmp_path / "nothing"), chunks.schema).count() == 0


def test_a_stream_adds_unseen_meetings_once(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()

    def chunk(rows):
        return rows.select("meeting_id", F.lit("summary").alias("level"), F.concat("meeting_id", F.lit("_0")).alias("chunk_id"), "text")

    def follow(lines, name):
        (folder / name).write_text("\n".join(json.dumps(x) for x in lines))
        incremental.follow(spark, str(folder), "meeting_id string, text string", path, str(tmp_path / "checkpoint"), chunk).awaitTermination(60)
        return sorted(r["meeting_id"] for r in index.load(spark, path).collect())

    assert follow([{"meeting_id": "a", "text": "x"}, {"meeting_id": "b", "text": "y"}], "1.json") == ["a", "b"]
    assert follow([{"meeting_id": "b", "text": "again"}, {"meeting_id": "c", "text": "z"}], "2.json") == ["a", "b", "c"]


def test_generators_fall_back(spark):
    class Broken:
        def generate(self, prompt):
            raise RuntimeError("no network")

    rows = spark.createDataFrame([(1, "one\ntwo")], "file_num int, text string")
    made = models.generate(rows, Broken(), "Summary of dataXXX:", fallback=models.TemplateGenerator(2)).first()
    assert made["generated"] == "one\ntwo" and made["error"] is None
    failed = models.generate(rows, Broken(), "x").first()
    assert failed["generated"] is None and "no network" in failed["error"]
