"""From questions to answers in one plan: plan, rewrite, retrieve and answer, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from ..sources.store import Store
from . import chunking, indexed, render, retrieval, rewrite
from .models import Embedder, embed

#: Chunks that a question gets, and how many more are fused before.
K, WIDER = 10, 2
#: Hits that are sent to every task.
FEW_HITS = 100_000


def rewrite_queries(questions: DataFrame, catalog: DataFrame, participants: Column, user: str, today: str) -> DataFrame:
    """question_id, rewritten and meeting_ids (an array): the three rewriting stages, one after the other.

    What a question refers to is detected, pronouns of the first person, times and parts of names are resolved, and a
    phrase for the latest meetings becomes their ids: those of the person whom the question names, else of the user
    where the question speaks of them and they take part in meetings, else of all.
    """
    detected = rewrite.detect(questions, participants)
    own = F.when(F.exists("pronouns", lambda p: p.isin(*rewrite.FIRST_PERSON)) & F.array_contains(participants, user), F.lit(user))
    resolved = rewrite.resolve(detected, user, today).withColumn("person", F.coalesce(F.try_element_at("persons", F.lit(1)), own))
    done = rewrite.with_latest(resolved.withColumn("text", F.col("resolved")), catalog)
    return done.select("question_id", "rewritten", F.coalesce("ids", F.array().cast("array<string>")).alias("meeting_ids"))


def retrieve(questions: DataFrame, chunks: DataFrame | Store, k: int = K, alpha: float = retrieval.ALPHA, vectors: DataFrame | None = None) -> DataFrame:
    """Hits of questions that need the corpus, in the meetings that they name, or in all if they name none that is known.

    questions: question_id, need_rag, text, meeting_ids and embedding. Rows: question_id, chunk_id, rank, hybrid_score.
    Of a saved index the summaries are searched.
    """
    asked = questions.filter("need_rag").withColumnRenamed("question_id", "query_id")
    scope = asked.select("query_id", F.explode("meeting_ids").alias("meeting_id"))
    queries = asked.select("query_id", "text", "embedding")
    if isinstance(chunks, Store):
        hits = indexed.search_meetings(chunks, queries, scope, k, alpha, candidates=WIDER * k)
    else:
        hits = retrieval.hybrid(chunks, queries, k, alpha, scope, fail_open=True, candidates=WIDER * k, vectors=vectors)
    return hits.select(F.col("query_id").alias("question_id"), "chunk_id", "rank", "hybrid_score")


def projected(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id and chunks: array<struct<rank, chunk_id, text, datetime>> in order, which is what an answer sees."""
    # Few hits, a few for each question, go to the chunks; many meet them by exchange.
    sent = F.broadcast(hits) if hits.count() <= FEW_HITS else hits
    rows = chunks.select("chunk_id", "text", "datetime").join(sent, "chunk_id")
    one = F.struct("rank", "chunk_id", "text", F.coalesce("datetime", F.lit("N/A")).alias("datetime"))
    return rows.groupBy("question_id").agg(F.sort_array(F.collect_list(one)).alias("chunks"))


def index_meetings(meetings: DataFrame, store: Store, embedder: Embedder, only_summary: bool = False, include_chunk_level: bool = False, limit: int = chunking.LIMIT) -> dict[str, int]:
    """Chunk, embed and index the meetings (sources.meetings.load) that the index has no chunk of; gives the counts."""
    fresh = meetings if not store.batches else meetings.join(store.chunks().select("meeting_id").distinct(), "meeting_id", "left_anti")
    chunks = chunking.all_levels(fresh, only_summary, include_chunk_level, limit)
    dated = chunks.join(fresh.select("meeting_id", "datetime"), "meeting_id", "left")
    return store.add(embed(dated, embedder))


def ask(questions: DataFrame, chunks: DataFrame | Store, catalog: DataFrame, participants: Column, user: str, today: str, embedder: Embedder | None = None, k: int = K, vectors: DataFrame | None = None) -> DataFrame:
    """An answer for every question (question_id, text, and embedding if no embedder is given).

    chunks: chunk_id, meeting_id, text, datetime, embedding, or a saved index of such chunks, whose summaries are
    searched. Vectors may stand in a table of their own (chunk_id, meeting_id, embedding). Rows: question_id, need_rag, need_rewrite, answer_mode, rewritten, meeting_ids, skipped, total_chunks,
    chunks and answer. A question that does not need the corpus is not searched for; its chunks are empty.
    """
    planned = rewrite.plan(questions)
    changed = rewrite_queries(planned.filter("need_rewrite"), catalog, participants, user, today)
    ready = planned.join(changed, "question_id", "left").withColumn("rewritten", F.coalesce("rewritten", "text")).withColumn("meeting_ids", F.coalesce("meeting_ids", F.array().cast("array<string>")))
    ready = ready.withColumn("text", F.col("rewritten"))
    # Questions are few beside the corpus and used several times below.
    ready = cut(ready if embedder is None else embed(ready, embedder))
    texts = chunks.chunks("summary") if isinstance(chunks, Store) else chunks
    found = projected(cut(retrieve(ready, chunks, k, vectors=vectors)), texts)
    said = render.dated_answers(ready.select(F.col("question_id").alias("query_id"), "text"), found.select(F.col("question_id").alias("query_id"), F.inline("chunks")))
    rows = ready.join(found, "question_id", "left").join(said.withColumnRenamed("query_id", "question_id"), "question_id")
    return rows.select(
        "question_id",
        "need_rag",
        "need_rewrite",
        "answer_mode",
        "rewritten",
        "meeting_ids",
        (~F.col("need_rag")).alias("skipped"),
        F.coalesce(F.size("chunks"), F.lit(0)).alias("total_chunks"),
        "chunks",
        "answer",
    )
