"""A corpus pipeline of stages over documents, each stage an operator of lodestrand.llm.

Each stage gets all that the stage before kept, as a written table, and its decisions take effect: language ID drops
documents without a language, near-dedup keeps one document of each group, substring dedup cuts repeated passages out
of the texts, mixing repeats or drops documents by source, and packing gives the pieces of the sequences. All but the
last return the columns of documents. Null texts and ids, empty tables and repeated rows are handled as the operators
state; a document that loses all of its words stays, with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import langid, minhash, mixing, packing, substring
from lodestrand.llm.common import Scratch, tune
from lodestrand.llm.queries import tokenizer_path

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is recognised; those without letters or with a score below one half go.

    Null and empty texts have no letters. Rows without a language do not train; null ids and repeated rows are judged
    by their text like any other.
    """
    tune(spark)
    model = langid.fit(docs, sample_chars=1_500_000)
    found = langid.identify(docs, model, keep=tuple(COLUMNS))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last, then by text hash.

    Decisions are taken by id and text hash, so one id on different texts is several documents. Repeated rows (one id
    and one text) become one row. Documents without words all stay. Only the keys of the rows that go are joined.
    """
    tune(spark)
    decided = minhash.near_duplicates(docs, percent=75).groupBy("doc_id", "text_hash").agg(F.first("stays").alias("stays"), F.count("*").alias("times"))
    decided = Scratch(spark, "near-dedup").save(decided.filter("not stays or times > 1"), "decided")
    own = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))

    def match(keys: DataFrame):
        return own["doc_id"].eqNullSafe(keys["doc_id"]) & (own["text_hash"] == keys["text_hash"])

    again = decided.filter("stays")
    once = own.join(decided, match(decided), "left_anti")
    return once.unionByName(own.join(again, match(again), "left_semi").dropDuplicates(["doc_id", "text_hash"])).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 35 words that stand in more than one place.

    All documents stay, one without words left with an empty text, and a null text becomes empty; repeated rows are
    documents of their own, so their windows repeat.
    """
    tune(spark)
    kept = substring.repeated(docs, length=35, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 1, 2, 3 over the sources, each at most three times.

    Documents without words are never taken. A null source is a source of its own; repeated rows are taken together.
    """
    tune(spark)
    taken = mixing.mix(docs, weights=(1, 2, 3), share=1.0, most=3.0, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).filter("size > 0 and taken > 0").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is the end id alone."""
    tune(spark)
    return packing.pack(docs, tokenizer_path(), size=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language ID and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
