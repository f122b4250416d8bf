import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import evaluate, retrieval

CHUNKS = "chunk_id long, meeting_id string, text string, embedding array<float>"
QUERIES = "query_id long, text string, embedding array<float>"


@pytest.fixture
def corpus(spark):
    rows = [
        (1, "a", "red apple pie", [1.0, 0.0]),
        (2, "a", "green apple", [0.0, 1.0]),
        (3, "b", "blue sky over the red sea", [1.0, 1.0]),
        (4, "b", None, None),
        (5, "c", "stone", [-1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "red apple apple", [2.0, 0.0]), (2, "nothing known", None)], QUERIES)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dense_ranks_by_cosine_with_ties_by_id(spark, corpus, asked):
    found = rows(retrieval.dense(corpus, asked, 3).select("query_id", "rank", "chunk_id", "score"))
    assert found == [(1, 1, 1, 1.0), (1, 2, 3, 0.707107), (1, 3, 2, 0.0)]


def brute_bm25(docs, query):
    lists = {k: (t or "").split() for k, t in docs.items()}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    df = {}
    for words in lists.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for k, words in lists.items():
        s = 0
        for w in query.split():
            if w in raw:
                tf = words.count(w)
                s += (floor if raw[w] < 0 else raw[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if round(s, 6) > 0:
            out[k] = round(s, 6)
    return out


def test_bm25_counts_repeated_query_words(spark, corpus, asked):
    want = brute_bm25({1: "red apple pie", 2: "green apple", 3: "blue sky over the red sea", 4: "", 5: "stone"}, "red apple apple")
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25(corpus, asked, 10).collect()}
    assert got == pytest.approx(want)


def test_scope_of_one_chunk_has_no_text_hits_but_a_hybrid_of_zero(spark, corpus, asked):
    scope = spark.createDataFrame([(1, "c")], "query_id long, meeting_id string")
    assert retrieval.bm25(corpus, asked, 5, scope).count() == 0
    assert rows(retrieval.hybrid(corpus, asked, 5, scope=scope).select("query_id", "chunk_id", "hybrid_score")) == [(1, 5, 0.0)]


def test_scope_of_two_chunks_gives_alpha_and_zero(spark, corpus, asked):
    scope = spark.createDataFrame([(1, "a")], "query_id long, meeting_id string")
    assert rows(retrieval.hybrid(corpus, asked, 5, scope=scope).select("chunk_id", "hybrid_score")) == [(1, 0.6), (2, 0.0)]


def test_unknown_meetings_search_everything_or_nothing(spark, corpus, asked):
    scope = spark.createDataFrame([(1, "unknown")], "query_id long, meeting_id string")
    whole = rows(retrieval.hybrid(corpus, asked, 5).select("query_id", "chunk_id", "hybrid_score"))
    assert rows(retrieval.hybrid(corpus, asked, 5, scope=scope, fail_open=True).select("query_id", "chunk_id", "hybrid_score")) == whole
    assert retrieval.hybrid(corpus, asked, 5, scope=scope).count() == 0


def test_hierarchy_ends_where_a_level_finds_nothing(spark, corpus, asked):
    from pyspark.sql import functions as F

    summaries = corpus.withColumn("references", F.array(F.lit("M001-T01")))
    entries = corpus.withColumn("entry_id", F.lit("M002-T01"))
    levels = {r["level"] for r in retrieval.hierarchical(corpus, summaries, entries, asked).collect()}
    assert levels == {"metadata", "summary"}


def test_ivf_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 4
    v = (centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 8)) * 0.3).astype(float)
    chunks = spark.createDataFrame([(i, "m", "", x.tolist()) for i, x in enumerate(v)], CHUNKS)
    asked = spark.createDataFrame([(i, "", v[i * 50].tolist()) for i in range(20)], QUERIES)
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.dense(chunks, asked, 5).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in retrieval.ivf(chunks, asked, 5, probes=8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_metrics_and_summary(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, chunk_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12)], "query_id long, chunk_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    scored = evaluate.retrieval_metrics(hits, relevant, queries, 2)
    assert rows(scored) [0] == (1, 0.5, 0.5, 0.5)
    done = evaluate.summary(scored, ["precision", "recall"]).first()
    assert done["recall"] == 0.5 and done["total_cases"] == 3 and done["successful_cases"] == 1


def test_dense_with_scopes_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 4)), 1)
    chunks = spark.createDataFrame([(i, f"m{i % 9}" if i % 10 else None, "", x.tolist()) for i, x in enumerate(v)], CHUNKS).repartition(3)
    q = np.round(rng.normal(size=(12, 4)), 1)
    asked = spark.createDataFrame([(i, "", x.tolist()) for i, x in enumerate(q)], QUERIES)
    pairs = [(i, f"m{j}") for i in range(8) for j in (i, i + 3)] + [(9, "unknown"), (1, "m1")]
    scope = spark.createDataFrame(pairs, "query_id long, meeting_id string")
    monkeypatch.setattr(retrieval, "SCOPE_BLOCK", 6)
    for fail_open in (False, True):
        want = []
        for i, x in enumerate(q):
            known = {m for k, m in pairs if k == i and m != "unknown"}
            rows = [(-round(float(x @ y / np.linalg.norm(x) / (np.linalg.norm(y) or 1)), 6), j) for j, y in enumerate(v) if not known and fail_open or j % 10 and f"m{j % 9}" in known]
            want += [(i, j, rank + 1) for rank, (_, j) in enumerate(sorted(rows)[:5])]
        got = retrieval.dense(chunks, asked, 5, scope, fail_open).select("query_id", "chunk_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_a_task_gives_k_rows_for_a_query(spark):
    """However many Arrow batches it reads."""
    rng = np.random.default_rng(6)
    chunks = spark.createDataFrame([(i, "m", "", x.tolist()) for i, x in enumerate(rng.normal(size=(5000, 4)))], CHUNKS).coalesce(1)
    asked = spark.createDataFrame([(i, "", x.tolist()) for i, x in enumerate(rng.normal(size=(3, 4)))], QUERIES)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        best = retrieval._Best(3, 4)
        for i in range(0, 5000, 100):
            best.add(np.repeat(np.arange(3), 100), rng.normal(size=300), np.tile(np.arange(i, i + 100), 3))
        best.prune()
        assert len(best.query) == 12
        assert retrieval.dense(chunks, asked, 4).count() == 12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_recall_of_the_registered_search(spark):
    import os

    from lodestrand.plans import catalog

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    exact, near = ({(r["query_id"], r["chunk_id"]) for r in catalog.QUERIES[n](spark, folder).collect()} for n in ("q17_dense_topk_exact", "q19_dense_topk_ivf"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_metrics_by_label_equal_those_by_pairs(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 99, 1)], "query_id long, chunk_id long, rank int")
    labelled = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (13, 1), (14, None)], "chunk_id long, label int")
    queries = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (4, None)], "query_id long, label int")
    relevant = queries.join(labelled, "label").select("query_id", "chunk_id")
    assert rows(evaluate.metrics_by_label(hits, queries, labelled, 2)) == rows(evaluate.retrieval_metrics(hits, relevant, queries, 2))


@pytest.mark.parametrize("scores", [7, 1 << 21])
def test_scores_in_tasks_equal_those_by_joins(spark, monkeypatch, scores):
    """Of queries with repeated and unknown words, scopes that overlap, and texts that are null, empty or alike."""
    own = random.Random(6)
    texts = [" ".join(own.choice("abcdefgh") for _ in range(own.randrange(1, 12))) for _ in range(60)] + [None, "", "a", "a"]
    chunks = spark.createDataFrame([(i, None if i % 9 == 8 else f"m{i % 5}", t) for i, t in enumerate(texts)], "chunk_id long, meeting_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(own.choice("abcdefghxyz") for _ in range(5))) for i in range(12)] + [(20, None), (21, "")], "query_id long, text string")
    scope = spark.createDataFrame([(i, f"m{j}") for i in range(8) for j in range(i % 4)] + [(9, "none")], "query_id long, meeting_id string")
    monkeypatch.setattr(retrieval, "SCORES", scores)
    ways = [dict(), dict(scope=scope, fail_open=True), dict(scope=scope, fail_open=False)]
    found = [sorted(map(tuple, retrieval.bm25(chunks, asked, 4, **w).select("query_id", "chunk_id", "score", "rank").collect())) for w in ways]
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    joined = [sorted(map(tuple, retrieval.bm25(chunks, asked, 4, **w).select("query_id", "chunk_id", "score", "rank").collect())) for w in ways]
    assert found == joined and all(found)


def scoped_case(spark):
    rows = [(i, f"m{i % 5}", " ".join(f"w{(i * j) % 23}" for j in range(1, i % 9 + 3)), None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id int, meeting_id string, text string, embedding array<float>")
    queries = spark.createDataFrame([(q, f"w{q} w{2 * q} w{q + 7} w{q}", None) for q in range(8)], "query_id int, text string, embedding array<float>")
    scope = spark.createDataFrame([(q, f"m{(q + i) % 5}") for q in range(8) for i in range(q % 3 + 1)], "query_id int, meeting_id string")
    return chunks, queries, scope


def test_scopes_at_hand_make_no_row_for_a_term_of_a_corpus(spark, monkeypatch):
    chunks, queries, scope = scoped_case(spark)
    found = sorted(map(tuple, retrieval.bm25(chunks, queries, 4, scope).collect()))
    monkeypatch.setattr(retrieval, "FEW_MEMBERS", 0)
    assert found == sorted(map(tuple, retrieval.bm25(chunks, queries, 4, scope).collect())) and len(found) > 8
    monkeypatch.undo()
    monkeypatch.setattr(retrieval, "floors", lambda *_: pytest.fail("all terms of all corpora became rows"))
    assert found == sorted(map(tuple, retrieval.bm25(chunks, queries, 4, scope).collect()))


def test_scores_are_added_up_in_bounded_steps(spark, monkeypatch):
    chunks, queries, scope = scoped_case(spark)
    want = [sorted(map(tuple, retrieval.bm25(chunks, queries, 4, s).collect())) for s in (None, scope)]
    monkeypatch.setattr(retrieval, "SCORES", 16)
    assert want == [sorted(map(tuple, retrieval.bm25(chunks, queries, 4, s).collect())) for s in (None, scope)]
    sizes = np.array([1, 40, 2, 3, 9, 9, 0, 1])
    for a, b in retrieval.cuts(sizes, 10):
        assert sizes[a:b].sum() <= 10 + sizes[a]
    assert sum((list(range(a, b)) for a, b in retrieval.cuts(sizes, 10)), []) == list(range(8))


def test_a_task_holds_little_beside_its_batch(spark, monkeypatch):
    """A batch of long texts, whose words all queries ask for, and as many short ones."""
    own = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(500)])
    said = [" ".join(own.choice(words, n)) for n in [700] * 3000 + [3] * 3000]
    few = spark.createDataFrame(list(enumerate(said[2980:3020])), "chunk_id long, text string").withColumn("meeting_id", F.lit("m"))
    asked = spark.createDataFrame([(i, " ".join(own.choice(words, 60))) for i in range(100)], "query_id long, text string")
    tasks, real = [], type(few).mapInArrow
    monkeypatch.setattr(type(few), "mapInArrow", lambda self, run, schema: tasks.append(run) or real(self, run, schema))
    retrieval.bm25(few, asked, 4)
    listed = [t.split() for t in said]
    batch = pa.RecordBatch.from_arrays([pa.array([""] * len(said)), pa.array(range(len(said)), pa.int64()), pa.array(map(len, listed), pa.int32()), pa.array(listed)], ["meeting", "chunk_id", "length", "tokens"])
    tracemalloc.start()
    found = list(tasks[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 400 and peak < 60e6
