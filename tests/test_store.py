import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import agent, indexed, models, retrieval
from lodestrand.sources.store import Store
from lodestrand.streaming import incremental

SCHEMA = "chunk_id string, meeting_id string, level string, text string, embedding array<float>, entry_id string, references array<string>, status string"
QUERY = "query_id long, text string, embedding array<float>"


def corpus(seed, n, levels=("summary",), meetings=5):
    own = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for level in levels:
        for i in range(n):
            text = " ".join(own.choice(words) for _ in range(own.randrange(1, 30)))
            vector = [own.gauss(0, 1) for _ in range(4)]
            rows.append((f"{level}-{i}", f"m{i % meetings}", level, text, vector, f"M{i % 6:03d}-T01" if level == "meeting" else None, [f"M{own.randrange(6):03d}-T01"] if level == "summary" else None, own.choice(["open", "done"])))
    return rows


@pytest.fixture
def queries(spark):
    own = random.Random(99)
    return spark.createDataFrame([(i, " ".join(f"w{own.randrange(45)}" for _ in range(4)), [own.gauss(0, 1) for _ in range(4)]) for i in range(6)], QUERY)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, tmp_path, **how):
    return Store(spark, str(tmp_path / "index"), 4, buckets=4, **how)


def same(left, right, columns="query_id chunk_id score rank"):
    names = columns.split()
    assert Counter(map(tuple, left.select(*names).collect())) == Counter(map(tuple, right.select(*names).collect()))


def scope_of(spark, key):
    return spark.createDataFrame([(0, "m1"), (0, "m3"), (1, "m2"), (2, "nowhere"), (4, "m1"), (4, "m3")], f"query_id long, {key} string")


def checked(spark, own, rows, queries, scoped=False):
    """All searches find what they find in the texts of the rows."""
    chunks = frame(spark, rows).filter("level = 'summary'")
    hybrid, plain = "query_id chunk_id rank vector_score bm25_score hybrid_score", scope_of(spark, "meeting_id")
    same(indexed.search(own, "summary", queries, 5), retrieval.hybrid(chunks, queries, 5), hybrid)
    if scoped:
        same(indexed.bm25(own, "summary", queries, 5, scope_of(spark, "scope_id")), retrieval.bm25(chunks, queries, 5, plain))
        same(indexed.search_meetings(own, queries, plain, 5), retrieval.hybrid(chunks, queries, 5, scope=plain, fail_open=True), hybrid)


def test_batches_are_searched_as_one(spark, tmp_path, queries):
    rows = corpus(1, 60)
    own = store(spark, tmp_path)
    for part in (rows[:25], rows[25:26], rows[26:]):
        own.add(frame(spark, part))
    assert own.batches == [0, 1, 2]
    checked(spark, Store(spark, own.path, 4), rows, queries, scoped=True)


def test_chunks_are_replaced_and_removed(spark, tmp_path, queries):
    rows, other = corpus(2, 40), corpus(3, 40)
    own = store(spark, tmp_path)
    own.add(frame(spark, other))
    assert own.add(frame(spark, rows[10:30])) == {"ok": 20, "failed": 0, "replaced": 20}
    assert own.add(frame(spark, rows[:12] + rows[30:])) == {"ok": 22, "failed": 0, "replaced": 22}
    checked(spark, own, rows, queries)
    out = spark.createDataFrame([("summary-3",), ("summary-17",), ("unknown",)], "chunk_id string")
    assert own.remove(out)["replaced"] == 2
    left = [r for r in rows if r[0] not in ("summary-3", "summary-17")]
    checked(spark, own, left, queries, scoped=True)
    assert own.add(frame(spark, rows[3:4]))["replaced"] == 0
    checked(spark, own, left + rows[3:4], queries)


def test_compaction_keeps_what_is_there(spark, tmp_path, queries):
    rows = corpus(4, 30, ("summary", "metadata"))
    own = store(spark, tmp_path)
    own.add(frame(spark, corpus(5, 30, ("summary", "metadata"))))
    own.add(frame(spark, rows))
    own.remove(levels=("metadata",))
    before = sorted(map(tuple, own.stats().collect()))
    own.compact()
    assert own.batches == [3] and sorted(map(tuple, own.stats().collect())) == before
    own.sweep()
    again = Store(spark, own.path)
    checked(spark, again, rows, queries)
    assert again.chunks("metadata").count() == 0
    again.add(frame(spark, corpus(6, 4)))
    assert again.batches == [3, 4]


def test_levels_and_counts(spark, tmp_path):
    own = store(spark, tmp_path)
    assert [r["n_chunks"] for r in own.stats().collect()] == [0] * 4
    bad = [(None, "m1", "summary", "x", None, None, None, None), ("a", "m1", "nothing", "x", None, None, None, None), ("b", "m1", "summary", None, None, None, None, None)]
    odd = [("c", None, "summary", "alone here", None, None, None, None), ("d", "m1", "summary", "", [0.0] * 4, None, None, None), ("d", "m1", "summary", "", [0.0] * 4, None, None, None)]
    assert own.add(frame(spark, bad + odd)) == {"ok": 2, "failed": 3, "replaced": 0}
    assert {(r["chunk_id"], r["level"], r["text"], r["batch"]) for r in own.failed().collect()} == {(None, "summary", "x", 0), ("a", "nothing", "x", 0), ("b", "summary", None, 0)}
    got = {r["level"]: tuple(r)[1:] for r in own.stats().collect()}
    assert got["summary"] == (2, 2, 1, 1) and got["chunk"] == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        own.chunks("nothing")
    with pytest.raises(ValueError):
        Store(spark, own.path, 8)
    asked = spark.createDataFrame([(1, "alone", None)], QUERY)
    assert Store(spark, str(tmp_path / "index"), 8, recreate=True).batches == [] and not (tmp_path / "index").exists()
    own = store(spark, tmp_path)
    own.add(frame(spark, odd))
    assert indexed.bm25(own, "meeting", asked, 5).count() == 0 and indexed.search(own, "metadata", asked, 5).count() == 0


def test_an_empty_index_finds_nothing(spark, tmp_path, queries):
    own = store(spark, tmp_path)
    own.add(frame(spark, []))
    assert indexed.search(own, "summary", queries, 5).count() == 0
    own.add(frame(spark, corpus(7, 8)))
    checked(spark, own, corpus(7, 8), queries)


def test_a_batch_is_done_once_or_not_seen(spark, tmp_path, queries):
    """What a failed run wrote is not read, and is written over when the batch is run again."""
    rows = corpus(8, 30)
    own = store(spark, tmp_path)
    own.add(frame(spark, rows[:10]), batch=0)

    class Stop(Exception):
        pass

    def fail(*_, **__):
        raise Stop

    broken = Store(spark, own.path)
    broken._finish = fail
    with pytest.raises(Stop):
        broken.add(frame(spark, corpus(9, 20)), batch=1)
    again = Store(spark, own.path)
    checked(spark, again, rows[:10], queries)
    done = again.add(frame(spark, rows[10:]), batch=1)
    assert again.add(frame(spark, corpus(9, 20)), batch=1) == done and again.batches == [0, 1]
    checked(spark, again, rows, queries)
    with pytest.raises(ValueError):
        again.add(frame(spark, rows), batch=-1)


def test_cells_are_fitted_once_and_prune(spark, tmp_path):
    own = random.Random(11)
    centres = [[own.gauss(0, 5) for _ in range(4)] for _ in range(8)]
    rows = [(f"c{i}", "m", "summary", "x", [v + own.gauss(0, 0.2) for v in centres[i % 8]], None, None, None) for i in range(400)]
    made = store(spark, tmp_path, cells=8, least=100)
    made.add(frame(spark, rows[:300]))
    before = made.centres("summary")
    made.add(frame(spark, rows[300:]))
    assert len(before) == 8 and np.array_equal(before, made.centres("summary"))
    asked = spark.createDataFrame([(i, "", centres[i]) for i in range(8)], QUERY)
    exact = {(r["query_id"], r["chunk_id"]) for r in indexed.dense(made, "summary", asked, 10).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in indexed.dense(made, "summary", asked, 10, probes=2).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    one = indexed.dense(made, "summary", asked.limit(1), 10, probes=1)
    assert one.count() == 10
    cells = {r[0] for r in indexed.nearest_cells(asked.limit(1), before, 1).select("cell").collect()}
    plan = made.vectors("summary", list(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    own = store(spark, tmp_path)
    own.add(frame(spark, corpus(12, 20)))
    plan = own.postings("summary", spark.createDataFrame([("w1",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "bucket" in filters and "level" in filters


def test_entries_and_the_hierarchy(spark, tmp_path, queries):
    rows = corpus(13, 25, ("metadata", "summary", "meeting"))
    own = store(spark, tmp_path)
    own.add(frame(spark, rows[:40]))
    own.add(frame(spark, rows[40:]))
    levels = {x: frame(spark, [r for r in rows if r[2] == x]) for x in ("metadata", "summary", "meeting")}
    entries = spark.createDataFrame([(0, "M001-T01"), (1, "M002-T01"), (1, "M003-T01"), (2, "M999-T01")], "query_id long, entry_id string")
    same(indexed.search_entries(own, queries, entries, 4), retrieval.by_entry(levels["meeting"], queries, entries, 4), "query_id chunk_id rank hybrid_score")
    got = indexed.hierarchical(own, queries, (3, 4, 5))
    want = retrieval.hierarchical(levels["metadata"], levels["summary"], levels["meeting"], queries, (3, 4, 5))
    same(got, want, "query_id level chunk_id rank hybrid_score")


def test_nearest_chunks_that_fit_filters(spark, tmp_path, queries):
    rows = corpus(14, 40)
    own = store(spark, tmp_path)
    own.add(frame(spark, rows))
    got = indexed.knn(own, "summary", queries, 3, {"status": "open"}, ["m1", "m2"], ("status", "meeting_id"))
    vectors = np.array([r[4] for r in rows], np.float32).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    want = set()
    for q in queries.collect():
        v = np.array(q["embedding"], float) / np.linalg.norm(q["embedding"])
        fit = sorted((-round((1 + round(float(x @ v), 6)) / 2, 7), r[0]) for x, r in zip(vectors, rows) if r[7] == "open" and r[1] in ("m1", "m2"))
        want |= {(q["query_id"], key, -s, i + 1) for i, (s, key) in enumerate(fit[:3])}
    assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert {(r["status"], r["meeting_id"]) for r in got.collect()} <= {("open", "m1"), ("open", "m2")}


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="other than 4 numbers"):
        store(spark, tmp_path).add(frame(spark, [("a", "m", "summary", "x", [1.0, 2.0], None, None, None)]))


def meetings_of(spark, numbers):
    rows = [(f"data{i:03d}", f"Talk {i}", f"2024-05-{i:02d}", f"- **[S{i:03d}-T01] Topic: budget {i}**\n  Reference: M{i:03d}-T01", f"## Topics\n- **Topic Title:** budget {i}\n  - Topic id: M{i:03d}-T01\n  - Reference: P001-P002", "said", f"brief {i}", []) for i in numbers]
    return spark.createDataFrame(rows, "meeting_id string, title string, datetime string, summary_text string, meeting_level_text string, conversation_text string, summary_brief string, actions array<struct<description_plain:string>>")


def test_meetings_are_indexed_once_and_asked(spark, tmp_path):
    embedder = models.HashingEmbedder(4)
    own = store(spark, tmp_path)
    assert agent.index_meetings(meetings_of(spark, [1, 2]), own, embedder, include_chunk_level=True) == {"ok": 8, "failed": 0, "replaced": 0}
    assert agent.index_meetings(meetings_of(spark, [1, 2, 3]), own, embedder, only_summary=True) == {"ok": 1, "failed": 0, "replaced": 0}
    assert {r["level"]: r["n_chunks"] for r in own.stats().collect()} == {"metadata": 2, "summary": 3, "meeting": 2, "chunk": 2}
    catalog = spark.createDataFrame([(f"data{i:03d}", f"2024-05-{i:02d}", ["Ada Lovelace"]) for i in (1, 2, 3)], "meeting_id string, date string, participants array<string>")
    asked = spark.createDataFrame([(1, "What was the budget in the last 2 meetings?"), (2, "Define budget")], "question_id long, text string")
    got = {r["question_id"]: r for r in agent.ask(asked, own, catalog, F.array(F.lit("Ada Lovelace")), "Ada Lovelace", "2024-05-15", embedder, k=5).collect()}
    assert sorted(c["chunk_id"] for c in got[1]["chunks"]) == ["data002_summary_0", "data003_summary_0"] and got[1]["chunks"][0]["datetime"].startswith("2024-05-0")
    assert got[2]["skipped"] and got[2]["total_chunks"] == 0
    level = indexed.hierarchical(own, spark.createDataFrame([(1, "brief 2", [1.0, 0.0, 0.0, 0.0])], QUERY)).select("level").distinct()
    assert {r[0] for r in level.collect()} == {"metadata", "summary", "meeting"}


def test_a_stream_feeds_the_index(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "fed")
    folder.mkdir()
    how = ("chunk_id string, meeting_id string, text string", path, str(tmp_path / "checkpoint"), lambda rows: rows.withColumn("level", F.lit("summary")))
    for number, lines in enumerate(([("a", "m1", "old words"), ("b", "m1", "two")], [("a", "m1", "new words here")])):
        (folder / f"{number}.json").write_text("".join(json.dumps(dict(zip(("chunk_id", "meeting_id", "text"), x))) + "\n" for x in lines))
        query = incremental.follow_store(spark, str(folder), *how)
        query.awaitTermination()
        assert query.exception() is None
    fed = Store(spark, path)
    assert fed.batches == [0, 1] and {r["chunk_id"]: r["text"] for r in fed.chunks().collect()} == {"a": "new words here", "b": "two"}
    assert [r["n_tokens"] for r in fed.stats(("summary",)).collect()] == [4]


def test_statistics_come_with_the_postings(spark, tmp_path):
    """A text is cut into tokens once: lists of postings count chunks by scope, and a slice has its chunks with their lengths."""
    rows = corpus(15, 30)
    own = store(spark, tmp_path)
    own.add(frame(spark, rows))
    assert not (tmp_path / "index" / "terms").exists()
    df = Counter((m, t) for _, m, _, text, *_ in rows for t in set(text.split()))
    assert {(r["scope_id"], r["term"]): r["df"] for r in own.terms("summary").collect()} == df
    own.add(frame(spark, rows[:10]))
    assert {(r["scope_id"], r["term"]): r["df"] for r in own.terms("summary").collect()} == df
    found = own.slices("summary", spark.createDataFrame([("w1",)], "term string")).collect()
    lengths = {c: n for r in found if r["term"] is None for c, n in zip(r["chunk_ids"], r["tfs"])}
    assert lengths == {r[0]: len(r[3].split()) for r in rows}
    assert len([r for r in found if r["term"]]) <= len({(r["batch"], r["slice"]) for r in found})
