"""Searches of a saved index (sources.store): what retrieval finds in texts, read from postings, statistics and cells.

No text is read to search. Words read the buckets of the queries' terms, dense search the cells that queries look into,
and statistics of any scope are sums over its meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from ..sources.store import Store
from ..sources.store import total as total_of
from . import filters, retrieval

#: Chunks found by the three levels of the hierarchical search.
LEVEL_K = (5, 10, 10)


def bm25(store: Store, level: str, queries: DataFrame, k: int, scope: DataFrame | None = None, fail_open: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: what retrieval.bm25 finds in the level's chunks.

    scope: query_id and scope_id (the meeting, or the entry at the level "meeting").
    """
    known = store.sizes(level).withColumnRenamed("scope_id", "meeting_id")
    members, own = retrieval.corpora(queries, known, _as_meetings(scope), fail_open)
    terms, held = cut(retrieval.asked_terms(own)), retrieval.at_hand(members, retrieval.FEW_MEMBERS)
    spread = retrieval.few(terms)
    meeting = F.lit("") if scope is None else retrieval.meeting_key(F.col("scope_id"))
    counts = store.counts(level)
    if scope is None:
        total = store.summary(level)
        if total is None:
            return _none(store, queries)
        n, length, floor = total
        one = store.spark.range(1).select(F.col("id").alias("corpus"), F.lit(n).cast("long").alias("n"), F.lit(length / n).alias("mean_length"), F.lit(floor).cast("double").alias("floor"))
        df = counts.join(spread(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum(total_of("dfs")).alias("df")).filter("df > 0").withColumn("corpus", F.lit(0).cast("long"))
        asked = retrieval.weighed(terms, one.drop("floor"), df, one.select("corpus", "floor"))
    else:
        sizes = store.sizes(level).select(meeting.alias("meeting"), "n", "length").join(members, "meeting")
        sizes = sizes.groupBy("corpus").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"))
        counts = counts.select("term", F.transform("scopes", retrieval.meeting_key).alias("meetings"), "dfs")
        words = counts.select("term", F.inline(F.arrays_zip(F.col("meetings").alias("meeting"), F.col("dfs").alias("df"))))
        one = F.collect_list(F.struct("meetings", "dfs"))
        listed = counts.groupBy("term").agg(one.alias("in")).select(F.flatten("in.meetings").alias("meetings"), F.flatten("in.dfs").alias("dfs"))
        asked = retrieval.weighed(terms, sizes, *retrieval.by_corpus(words, terms, sizes, held, lambda rows: rows.join(members, "meeting"), listed))
    listed = retrieval.at_hand(asked, retrieval.FEW_TERMS)
    if listed is not None and held is not None:
        # A slice's lists meet its chunks in one task, whatever the number of queries.
        rows = store.slices(level, terms).withColumn("meeting", meeting).drop("scope_id")
        rows = rows.repartition("batch", "slice").sortWithinPartitions("batch", "slice")
        return retrieval.scored_in_tasks(rows, listed, held, k, queries.schema["query_id"].dataType.simpleString(), store._kind("chunk_id"), by_chunk)
    asked = cut(asked)
    posts = store.postings(level, terms, terms.count() <= retrieval.FEW_TERMS).select(meeting.alias("meeting"), "chunk_id", "length", "term", "tf")
    return retrieval.scored(posts.join(spread(asked.select("term").distinct()), "term", "left_semi").join(members, "meeting"), asked, k)


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meeting, chunk_id, length, and lists of tokens and tf, from the lists of slices that come one after the other.

    Postings of chunks that a later batch replaces meet nothing.
    """
    for table in _slices(batches):
        none = pc.is_null(table.column("term"))
        docs, lists = table.filter(none), table.filter(pc.invert(none))
        if not docs.num_rows:
            continue
        chunk_id, length = docs.column("chunk_ids").combine_chunks().flatten(), docs.column("tfs").combine_chunks().flatten()
        meeting = docs.column("meeting").combine_chunks().take(pa.array(np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs.column("chunk_ids")).to_numpy())))
        term = np.repeat(np.arange(lists.num_rows), pc.list_value_length(lists.column("chunk_ids")).to_numpy())
        row = pc.index_in(lists.column("chunk_ids").combine_chunks().flatten(), value_set=chunk_id)
        full = row.is_valid().to_numpy(zero_copy_only=False)
        row = row.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.flatnonzero(full)
        order = order[np.argsort(row[order], kind="stable")]
        starts = pa.array(np.searchsorted(row[order], np.arange(len(chunk_id) + 1)), pa.int32())
        tokens = lists.column("term").combine_chunks().take(pa.array(term[order]))
        tf = lists.column("tfs").combine_chunks().flatten().take(pa.array(order))
        yield pa.RecordBatch.from_arrays([meeting, chunk_id, length, pa.ListArray.from_arrays(starts, tokens), pa.ListArray.from_arrays(starts, tf)], ["meeting", "chunk_id", "length", "tokens", "tf"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one slice at a time, from rows in the order of their slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("batch", "slice")], axis=1).astype(np.int64)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def dense(store: Store, level: str, queries: DataFrame, k: int, scope: DataFrame | None = None, fail_open: bool = False, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the chunks with the largest cosine, exact within what is looked at.

    With probes a query looks into so many cells nearest to it, and only cells that some query looks into are read;
    without, or with a scope, or where the level has no cells, it looks at everything allowed.
    """
    centres = None if probes is None or scope is not None else store.centres(level)
    if centres is None:
        rows = store.vectors(level).select("chunk_id", F.col("scope_id").alias("meeting_id"), "embedding")
        return retrieval.dense(rows, queries, k, _as_meetings(scope), fail_open)
    looked = cut(nearest_cells(queries, centres, probes))
    read = [r[0] for r in looked.select("cell").distinct().collect()]
    rows = store.vectors(level, read).select("chunk_id", F.col("cell").cast("string").alias("meeting_id"), "embedding")
    return retrieval.dense(rows, queries, k, looked.select("query_id", F.col("cell").cast("string").alias("meeting_id")), fail_open=False)


def nearest_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """query_id and cell: the cells with the nearest centres, so many for each query with a vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = np.argsort((centres**2).sum(axis=1) - 2 * v @ centres.T, axis=1, kind="stable")[:, :probes]
                ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), own.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.ravel().astype(np.int32))], ["query_id", "cell"])

    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", retrieval.unit(F.col("embedding")).alias("v"))
    return asked.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell int")


def search(store: Store, level: str, queries: DataFrame, k: int, alpha: float = retrieval.ALPHA, scope: DataFrame | None = None, fail_open: bool = False, candidates: int | None = None, probes: int | None = None) -> DataFrame:
    """Dense and BM25 lists of `candidates` hits (k if not given) of a level, fused into k."""
    n = candidates or k
    return retrieval.fuse(dense(store, level, queries, n, scope, fail_open, probes), bm25(store, level, queries, n, scope, fail_open), k, alpha)


def search_meetings(store: Store, queries: DataFrame, meetings: DataFrame, k: int, alpha: float = retrieval.ALPHA, candidates: int | None = None) -> DataFrame:
    """Summaries of allowed meetings (query_id, meeting_id); a query without any that is known searches all summaries."""
    return search(store, "summary", queries, k, alpha, meetings.select("query_id", F.col("meeting_id").alias("scope_id")), True, candidates)


def search_entries(store: Store, queries: DataFrame, entries: DataFrame, k: int, alpha: float = retrieval.ALPHA) -> DataFrame:
    """Chunks of the level "meeting" with allowed entries (query_id, entry_id); without any nothing is found."""
    return search(store, "meeting", queries, k, alpha, entries.select("query_id", F.col("entry_id").alias("scope_id")), False)


def hierarchical(store: Store, queries: DataFrame, k: tuple[int, int, int] = LEVEL_K, alpha: float = retrieval.ALPHA) -> DataFrame:
    """query_id, level, chunk_id, rank, hybrid_score: meetings by their metadata, their summaries, and what these refer to.

    A query that finds nothing at a level has no rows at the levels below. Chunks of summaries have references.
    """
    first = cut(search(store, "metadata", queries, k[0], alpha))
    meetings = first.join(store.chunks("metadata").select("chunk_id", "meeting_id"), "chunk_id").select("query_id", "meeting_id").distinct()
    on = cut(queries.join(meetings.select("query_id").distinct(), "query_id", "left_semi"))
    second = cut(search_meetings(store, on, meetings, k[1], alpha))
    named = second.join(store.chunks("summary").select("chunk_id", "references"), "chunk_id")
    wanted = cut(named.select("query_id", F.explode("references").alias("entry_id")).distinct())
    third = search_entries(store, on.join(wanted.select("query_id").distinct(), "query_id", "left_semi"), wanted, k[2], alpha)
    parts = [hits.select("query_id", F.lit(level).alias("level"), "chunk_id", "rank", "hybrid_score") for level, hits in (("metadata", first), ("summary", second), ("meeting", third))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def knn(store: Store, level: str, queries: DataFrame, k: int, wanted: dict | None = None, meeting_ids: list[str] | None = None, columns: tuple[str, ...] = ("meeting_id", "text")) -> DataFrame:
    """query_id, chunk_id, score, rank and columns of the k nearest chunks of a level that fit all filters.

    wanted is a nested filter (filters.compile), meeting_ids an allowed list; both hold before anything is scored. The
    score is (1 + cosine) / 2.
    """
    chunks = store.chunks(level)
    fits = filters.compile(chunks, wanted or {})
    allowed = chunks.filter(fits if meeting_ids is None else fits & F.col("meeting_id").isin(meeting_ids))
    rows = store.vectors(level).join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("scope_id").alias("meeting_id"), "embedding")
    hits = retrieval.dense(rows, queries, k).withColumn("score", F.round((F.col("score") + 1) / 2, 7))
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id").select("query_id", "chunk_id", "score", "rank", *columns)


def _as_meetings(scope: DataFrame | None) -> DataFrame | None:
    return None if scope is None else scope.select("query_id", F.col("scope_id").alias("meeting_id"))


def _none(store: Store, queries: DataFrame) -> DataFrame:
    """No hits."""
    kind = store._kind("chunk_id") if store.batches else "string"
    return store.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double, rank int")
