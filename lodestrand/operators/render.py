"""Rendering: contexts for an answer, outlines as text, and an extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import local_date

def contexts(hits: DataFrame, most: int | None = 15) -> DataFrame:
    """query_id, n_chunks and the context: `[id] (Date: date)`, the text and a blank line, by rank, at most so many.

    hits: query_id, rank, chunk_id, datetime, text.
    """
    block = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] (Date: "), F.coalesce("datetime", F.lit("None")), F.lit(")\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = hits if most is None else hits.filter(F.col("rank") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"))


def with_empty(queries: DataFrame, rendered: DataFrame, empty: str = "No relevant context found.") -> DataFrame:
    """What contexts gives, with a row for every query: no chunks and a message for those without hits."""
    rows = queries.select("query_id").join(rendered, "query_id", "left")
    return rows.select("query_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("context", F.lit(empty)).alias("context"))


def outline(topic: Column, parts: Column) -> Column:
    """`Discussion on` a topic, then its parts with their bullets indented, a blank line between.

    parts is array<struct<topic_name, bullet_points<struct<point>>>>.
    """
    points = lambda p: F.transform(p["bullet_points"], lambda b: F.concat(F.lit("  - "), b["point"]))
    listed = F.transform(parts, lambda p: F.array_join(F.concat(F.array(F.concat(F.lit("- "), p["topic_name"])), points(p)), "\n"))
    return F.btrim(F.array_join(F.concat(F.array(F.concat(F.lit("Discussion on "), topic)), listed), "\n\n"), F.lit(" \n\r\t"))


#: What an answer says without any chunk, and without one of a day that the question names.
NOTHING, NO_DAY = "No relevant information was found for your query.", "No information is available for "


def _said() -> Column:
    """A chunk's first sentence and its id as citation."""
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^.!?\n]*[.!?]?)", 1)
    return F.concat(first, F.lit(" ["), F.col("chunk_id").cast("string"), F.lit("]"))


def extractive_answer(hits: DataFrame, most: int = 3) -> DataFrame:
    """query_id and answer: the first sentence of the best chunks, each with its chunk as citation, by rank.

    A query without hits has no row; answers() adds a message for these.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", _said().alias("said"))))
    return hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "\n").alias("answer"))


def answers(queries: DataFrame, hits: DataFrame, empty: str = NOTHING) -> DataFrame:
    """An answer for every query."""
    return queries.select("query_id").join(extractive_answer(hits), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(empty)))


def dated_answers(queries: DataFrame, hits: DataFrame, most: int = 3, empty: str = NOTHING) -> DataFrame:
    """An answer for every query (query_id, text), by day where its text names days.

    Each day (YYYY-MM-DD) is a section in the order of the text: the first sentences of the best chunks of that day, or
    that there is none. A text without days is answered by the best chunks of all. hits: query_id, rank, chunk_id,
    datetime and text; a query's hits are a list in one row.
    """
    one = F.struct("rank", _said().alias("said"), local_date(F.col("datetime")).alias("day"))
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("found"))
    days = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)))
    rows = queries.select("query_id", days.alias("days")).join(found, "query_id", "left")

    def listed(chunks: Column) -> Column:
        return F.array_join(F.transform(F.slice(chunks, 1, most), lambda x: x["said"]), "\n")

    def section(day: Column) -> Column:
        own = F.filter("found", lambda x: x["day"] == day)
        return F.when(F.size(own) > 0, F.concat(day, F.lit(":\n"), listed(own))).otherwise(F.concat(F.lit(NO_DAY), day, F.lit(".")))

    said = F.when(F.size("days") > 0, F.array_join(F.transform("days", section), "\n\n")).otherwise(listed(F.col("found")))
    return rows.select("query_id", F.when(F.col("found").isNull(), F.lit(empty)).otherwise(said).alias("answer"))
