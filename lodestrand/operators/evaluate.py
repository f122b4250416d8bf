"""Evaluation: retrieval metrics against labels, and null-ignoring summaries of judged scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall and reciprocal rank at k. A query without relevant chunks has null recall.

    hits: query_id, chunk_id, rank; relevant: query_id, chunk_id.
    """
    marked = hits.filter(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    by_query = marked.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = queries.select("query_id").join(by_query, "query_id", "left").join(totals, "query_id", "left")
    return rows.select(
        "query_id",
        F.round(F.coalesce("found", F.lit(0)) / F.lit(k), 6).alias("precision"),
        F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def metrics_by_label(hits: DataFrame, queries: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """What retrieval_metrics gives where a chunk is relevant to the queries of its label, without listing these pairs.

    hits: query_id, chunk_id, rank; queries: query_id, label (null: nothing is relevant); labelled: chunk_id, label.
    """
    own = hits.filter(F.col("rank") <= k).join(labelled.select("chunk_id", F.col("label").alias("_said")), "chunk_id", "left")
    marked = own.join(queries.select("query_id", "label"), "query_id").withColumn("hit", F.coalesce(F.col("_said") == F.col("label"), F.lit(False)))
    by_query = marked.groupBy("query_id").agg(F.count_if("hit").alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    totals = labelled.groupBy("label").agg(F.count("*").alias("n_relevant"))
    rows = queries.join(totals, "label", "left").join(by_query, "query_id", "left")
    return rows.select(
        "query_id",
        F.round(F.coalesce("found", F.lit(0)) / F.lit(k), 6).alias("precision"),
        F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


#: A judge scores (question, answer, ground_truth, contexts) between 0 and 1, or gives None where it cannot.
Judge = Callable[[str, str, str, list[str]], float | None]


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", (text or "").lower()))


def _covered(part: set[str], whole: set[str]) -> float | None:
    return len(part & whole) / len(part) if part else None


#: Judges without a model: shares of words. A model's judges take their place.
WORD_JUDGES: dict[str, Judge] = {
    "faithfulness": lambda question, answer, truth, contexts: _covered(_words(answer), _words(" ".join(contexts))),
    "answer_relevancy": lambda question, answer, truth, contexts: _covered(_words(question), _words(answer)),
    "answer_correctness": lambda question, answer, truth, contexts: _covered(_words(truth), _words(answer)),
    "context_recall": lambda question, answer, truth, contexts: _covered(_words(truth), _words(" ".join(contexts))),
}


def judged(cases: DataFrame, judges: dict[str, Judge] = WORD_JUDGES) -> DataFrame:
    """id, a column for each judge, and error: what went wrong in the judges that failed, whose score is null.

    cases: id, question, answer, ground_truth and contexts (array<string>).
    """
    names = list(judges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case in batch.to_pylist():
                scores, errors = [], []
                for name in names:
                    score = None
                    try:
                        score = judges[name](case["question"] or "", case["answer"] or "", case["ground_truth"] or "", [c or "" for c in case["contexts"] or []])
                    except Exception as e:  # a judge's failure is this case's result
                        errors.append(f"{name}: {type(e).__name__}: {e}")
                    scores.append(score)
                rows.append((case["id"], *scores, "; ".join(errors) or None))
            if rows:
                kinds = [pa.string(), *[pa.float64()] * len(names), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", *names, "error"])

    wanted = cases.select(F.col("id").cast("string").alias("id"), "question", "answer", "ground_truth", "contexts")
    return wanted.mapInArrow(run, "id string, " + ", ".join(f"`{n}` double" for n in names) + ", error string")


def run(golden: DataFrame, answer: Callable[[DataFrame], DataFrame], judges: dict[str, Judge] = WORD_JUDGES) -> tuple[DataFrame, DataFrame]:
    """Scores of every case of a golden set and their summary.

    answer takes question_id and text and gives question_id, answer and chunks, as agent.ask does. Cases also have
    meeting_recall: the share of the relevant meetings that a chunk's id begins with.
    """
    asked = golden.select(F.col("id").alias("question_id"), F.col("question").alias("text"))
    answered = cut(answer(asked).select(F.col("question_id").alias("id"), "answer", "chunks"))
    cases = golden.join(answered, "id", "left").withColumn("contexts", F.transform("chunks", lambda c: c["text"]))
    hit = F.filter("relevant_meeting_ids", lambda m: F.exists("chunks", lambda c: F.startswith(c["chunk_id"].cast("string"), m)))
    recall = cases.select("id", F.when(F.size("relevant_meeting_ids") > 0, F.coalesce(F.size(hit), F.lit(0)) / F.size("relevant_meeting_ids")).alias("meeting_recall"))
    scores = cut(judged(cases, judges).join(recall, "id"))
    return scores, summary(scores, [*judges, "meeting_recall"])


def summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric over rows that have it, the number of rows, and of rows that have all metrics."""
    complete = F.lit(True)
    for m in metrics:
        complete = complete & F.col(m).isNotNull()
    return scores.agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics], F.count("*").alias("total_cases"), F.count_if(complete).alias("successful_cases"))


def report(summarised: DataFrame) -> DataFrame:
    """The summary as one JSON line."""
    return summarised.select(F.to_json(F.struct("*")).alias("value"))
