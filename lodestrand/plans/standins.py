"""Stand-ins on the test tables for what meeting directories hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..sources.scratch import folder
from ..sources.spread import spread
from ..sources.store import Store

#: How questions begin, persons and the day they are asked; the tables' invented prose has nothing for rules to find.
QUESTIONS = [
    "What did I promise in the last meeting?",
    "Summarise the last 3 meetings for me",
    "What were the action items from recent meetings?",
    "Who is Lovelace meeting tomorrow?",
    "Did Ada and Hopper discuss compilers yesterday?",
    "What is a hash join?",
    "Define latency",
    "What did Grace Hopper say 2 weeks ago?",
    "Show our minutes from 2024-05-01",
    "Which decisions did we make last week?",
    "Translate hello into French",
    "What happened in the previous 2 meetings?",
    "Write a poem about rain",
    "Is Turing joining us today?",
    "I think my notes on Turing are missing",
    "Explain what the transcripts say about budgets",
    "What was agreed 3 days ago by Edsger?",
    "Past meetings with Barbara, please",
    "How do I sort a list?",
    "Did they mention Liskov last month?",
    "Summarise the talks of November 2025 on",
    "Which risks came up in March:",
    "What was agreed on 5 June 2023 and the day before yesterday?",
]
#: Beginnings of questions, for those that are made of benchmark items.
OPENINGS = ["What did Hopper say in the last 2 meetings about", "What did I promise in the last meeting on", "Define", "What was agreed in recent meetings:", "Find minutes with", "What was said on 2024-05-03, 2024-05-04 and in 2031 on", "Which talks of 2024-05-06 and yesterday were about"]
PERSONS = ["Ada Lovelace", "Grace Hopper", "Alan Turing", "Edsger Dijkstra", "Barbara Liskov", "Speaker 1", "Host"]
USER, TODAY = "Robin", "2024-05-15"


#: Tables of texts, whose rows cost more than reading them does.
TEXTS = ("documents", "conversations", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the meeting, the language the level."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("meeting_id"), "text", F.col("lang").alias("level"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without vectors, for what needs texts only."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("meeting_id"), "text", F.col("lang").alias("level"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' vectors without texts, for what needs vectors only."""
    return chunks(spark, sf_dir).select("chunk_id", "meeting_id", "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed meetings for each query: two sources for most, an unknown one for every seventh, none for every fifth."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    named = F.when(q["query_id"] % 7 == 6, F.array(F.lit("unknown"))).otherwise(F.array(F.concat(F.lit("src"), (F.col("query_id") % 4).cast("string")), F.concat(F.lit("src"), (F.col("query_id") % 4 + 4).cast("string"))))
    return q.filter("query_id % 5 <> 4").select("query_id", F.explode(named).alias("meeting_id"))


#: Lines that one task gathers into orders. Keys in order compress so well that bytes of a shuffle do not bound a task.
LINES = 400_000


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meetings: suppliers take part, part names are topics, lines are actions; pending orders are undated.

    Lines are dealt to tasks by their number, so what a task holds does not grow with the tables.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    named = lines.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    task = F.format_string("%02d %s %s", F.col("l_linenumber"), "l_returnflag", "p_name")
    by_order = named.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("participants"), F.sort_array(F.collect_set("p_name")).alias("topics"), F.sort_array(F.collect_list(task)).alias("action_tasks"))
    dated = F.when(F.col("o_orderstatus") != "P", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), dated.alias("datetime"))
    return orders.join(by_order, F.col("meeting_id") == F.col("l_orderkey")).drop("l_orderkey")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as meetings with a summary: a bullet for each turn, topics by users, actions by assistants.

    Columns: conv_id, summary_text and participants (names to assign).
    """
    turn = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    first = F.regexp_extract("text", r"^(\S+)", 1)
    head = F.when(F.col("role") == "assistant", F.format_string("- **[S%03d-A%02d] Action: %s to %s**", F.col("conv_id"), F.col("turn") + 1, first, F.substring("text", 1, 60))).otherwise(F.format_string("- **[S%03d-T%02d] Topic: %s**", F.col("conv_id"), F.col("turn") + 1, F.substring("text", 1, 60)))
    bullet = F.concat(head, F.lit("\n  "), "text", F.format_string("\n  Reference: M%03d-T%02d, M%03d-A%02d", F.col("conv_id"), F.col("turn") + 1, F.col("conv_id"), F.col("turn") + 2))
    rows = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", bullet.alias("bullet")))).alias("bullets"), F.array_sort(F.collect_set(F.concat(first, F.lit(" Smith")))).alias("participants"))
    return rows.select("conv_id", F.array_join(F.transform("bullets", lambda b: b["bullet"]), "\n").alias("summary_text"), "participants")


def entry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as meeting-level text: a section for each role, an entry for each turn, a preamble before."""
    turn = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    entry = F.concat(F.format_string("- **Topic Title:** %s\n  - Topic id: M%03d-T%02d\n", F.substring("text", 1, 40), F.col("conv_id"), F.col("turn") + 1), F.lit("  "), "text", F.format_string("\n  - Reference: P%03d–P%03d, P%03d", F.col("turn") + 3, F.col("turn") + 1, F.col("turn") + 2))
    section = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("## "), "role", F.lit("\n"))).otherwise(F.lit(""))
    rows = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(section, entry).alias("entry")))).alias("entries"))
    return rows.select("conv_id", F.concat(F.lit("Preamble of the meeting\n"), F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")).alias("text"))


def bulleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are bullets, behind a line that is none."""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Summary\n- "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n- "))).alias("text"))


def _said() -> Column:
    """A benchmark item's words without what rules look for."""
    return F.trim(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z]+", " "), r"(?i)\b(i|me|my|mine|we|us|our|ours|he|she|they|him|her|them)\b", "x"))


def _opened(openings: list[str]) -> Column:
    """The item's words behind the opening of its turn."""
    return F.concat(F.element_at(F.array(*map(F.lit, openings)), (F.col("query_id") % len(openings) + 1).cast("int")), F.lit(" "), _said())


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each benchmark item: one of QUESTIONS in turn, and the item's words behind it."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.select(F.col("query_id").alias("question_id"), _opened(QUESTIONS).alias("text"))


def persons() -> Column:
    return F.array(*map(F.lit, PERSONS))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each benchmark item, with its vector: what the rules look for before the item's words."""
    return queries(spark, sf_dir).select(F.col("query_id").alias("question_id"), _opened(OPENINGS).alias("text"), "embedding")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as meetings of two persons each; the first holds the last of its digits days."""
    sources = read(spark, sf_dir, "documents").select(F.col("source").alias("meeting_id")).filter("source is not null").distinct()
    number = F.coalesce(F.nullif(F.regexp_extract("meeting_id", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    person = lambda i: F.element_at(persons(), ((number + i) % 5 + 1).cast("int"))
    return sources.select("meeting_id", F.format_string("2024-05-%02d", number % 28 + 1).alias("date"), F.array(person(0), person(1)).alias("participants"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog call for each benchmark item: its number says which type, and what is asked for."""
    kinds = F.array(*map(F.lit, [*catalog.CALLS, "find_topic"]))
    key = F.col("item_id")
    turn = (key / 8).cast("int")
    person = F.format_string("Supplier#%09d", key % 5 + 1)
    return read(spark, sf_dir, "benchmark").select(
        key.alias("call_id"),
        F.element_at(kinds, (key % 8 + 1).cast("int")).alias("query_type"),
        (turn % 5).cast("int").alias("n"),
        F.when(turn % 2 == 1, person).alias("person_name"),
        F.when(turn % 4 != 3, F.when(key % 8 == 0, F.format_string("suplier %d", key % 90)).otherwise(person)).alias("fuzzy_name"),
        F.element_at(F.array(*map(F.lit, ["yesterday", "2 weeks ago", "November 2025", "some day", ""])), (turn % 5 + 1).cast("int")).alias("date_str"),
        (1994 + turn % 7).cast("int").alias("year"),
        (turn % 13).cast("int").alias("month"),
        F.when(turn % 3 != 2, F.concat((1993 + turn % 6).cast("string"), F.lit("-03-15"))).alias("start_date"),
        F.when(turn % 3 == 0, F.concat((1993 + turn % 6).cast("string"), F.lit("-06-10"))).when(turn % 6 == 2, "1993-01-31").alias("end_date"),
    )


def saved_index(spark: SparkSession) -> Store:
    """A new index in the shared folder."""
    return Store(spark, folder(spark, "index"), 64)


def summaries_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the level "summary"."""
    return chunks(spark, sf_dir).withColumn("level", F.lit("summary"))


def _dated(rows: DataFrame) -> DataFrame:
    """Add the day of a chunk's source as talks() has it: an expression over its name, so no text moves."""
    number = F.coalesce(F.nullif(F.regexp_extract("meeting_id", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.withColumn("datetime", F.when(F.col("meeting_id").isNotNull(), F.format_string("2024-05-%02d", number % 28 + 1)))


def dated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(chunks(spark, sf_dir))


def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated chunks without vectors."""
    return _dated(texts(spark, sf_dir))
