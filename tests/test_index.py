import json
import shutil

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import index, meetings
from lodestrand.streaming import incremental

SCHEMA = "chunk_id string, meeting_id string, level string, text string, embedding array<float>"


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([(f"c{i:02}", f"m{i % 3}", index.LEVELS[i % 2], f"word{i} word word{i}", [1.0]) for i in range(20)], SCHEMA)


def test_postings_and_statistics_are_saved_and_follow_appends(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    index.save(chunks.filter("chunk_id < 'c10'"), path, 1)
    index.append(spark, chunks.filter("chunk_id >= 'c10'"), path)
    columns = ["level", "chunk_id", "term", "tf", "length"]
    assert sorted(map(tuple, index.load_postings(spark, path).select(columns).collect())) == sorted(map(tuple, index.postings(chunks).select(columns).collect()))
    assert sorted(map(tuple, index.load_statistics(spark, path).select("level", "term", "df", "cf").collect())) == sorted(map(tuple, index.term_stats(chunks).collect()))


def test_unknown_levels_are_refused(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    index.save(chunks, path, 1)
    for write in (lambda df: index.append(spark, df, path), lambda df: index.save(df, path + "2", 1)):
        with pytest.raises(Exception, match="unknown level other"):
            write(chunks.limit(1).withColumn("level", F.lit("other")))
    with pytest.raises(ValueError):
        index.check_level("other")


def test_chunks_without_a_manifest_are_not_replaced(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    index.save(chunks, path, 1)
    shutil.rmtree(f"{path}/manifest")
    with pytest.raises(Exception, match="manifest"):
        index.load_or_empty(spark, path, chunks.schema)
    assert spark.read.parquet(f"{path}/chunks").count() == 20


def test_a_streamed_index_has_its_dimension(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"meeting_id": "a", "text": "x"}))

    def chunk(rows):
        return rows.select("meeting_id", F.lit("summary").alias("level"), F.col("meeting_id").alias("chunk_id"), "text")

    incremental.follow(spark, str(folder), "meeting_id string, text string", path, str(tmp_path / "checkpoint"), chunk, dimension=1536).awaitTermination(60)
    assert index.load(spark, path, 1536).count() == 1


def test_ordinals_go_on_without_gaps(spark, chunks):
    old = index.numbered(chunks.filter("chunk_id < 'c07'").repartition(3))
    assert [r["ordinal"] for r in old.orderBy("chunk_id").collect()] == list(range(7))
    new = index.with_ordinals(chunks.filter("chunk_id >= 'c07'").repartition(4), old)
    assert [r["ordinal"] for r in new.orderBy("chunk_id").collect()] == list(range(7, 20))
    assert index.with_ordinals(chunks.limit(2), old.limit(0)).agg(F.min("ordinal")).first()[0] == 0


def test_inverted_ids(chunks):
    got = {r["meeting_id"]: r["chunk_ids"] for r in index.inverted(chunks, "meeting_id").collect()}
    assert got["m1"] == [f"c{i:02}" for i in range(1, 20, 3)] and len(got) == 3


def test_quarantine(spark):
    rows = [("a", "m", "summary", "x", None), (None, "m", "summary", "x", None), ("b", "m", "summary", None, None), ("c", "m", "other", "x", None), ("d", "m", None, "x", None)]
    good, bad, counts = index.quarantine(spark.createDataFrame(rows, SCHEMA))
    assert [r["chunk_id"] for r in good.collect()] == ["a"] and bad.count() == 4 and tuple(counts.first()) == (1, 4)


def test_rows_as_json_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", "three")], "k string, text string")
    meetings.write_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect())) == [("a", "one\ntwo"), ("b", "three")]
    meetings.write_texts(df, str(tmp_path / "texts"), "k")
    assert spark.read.text(str(tmp_path / "texts/k=b")).first()[0] == "three"
