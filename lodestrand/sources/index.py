"""The index: chunks, postings and statistics as Parquet, partitioned by level, with a manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .scratch import cut

LEVELS = ("metadata", "summary", "meeting", "chunk")


def check_level(level: str) -> str:
    """The level, if it is one."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; known: {', '.join(LEVELS)}")
    return level


def postings(chunks: DataFrame) -> DataFrame:
    """level, chunk_id, term, tf and the chunk's length in tokens."""
    rows = chunks.select("level", "chunk_id", tokens(F.col("text")).alias("tokens"))
    return rows.select("level", "chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("level", "chunk_id", "length", "term").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """level, term, df (chunks that have it) and cf (its occurrences)."""
    return postings(chunks).groupBy("level", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _checked(chunks: DataFrame) -> DataFrame:
    """The chunks; writing them fails at the first level that is none."""
    wrong = F.raise_error(F.concat(F.lit("unknown level "), F.coalesce(F.col("level"), F.lit("null"))))
    return chunks.withColumn("level", F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise(wrong.cast("string")))


def save(chunks: DataFrame, path: str, dimension: int, mode: str = "overwrite") -> None:
    """Write a manifest with the vectors' dimension, chunks by level, their postings, and statistics of terms.

    The manifest comes first: chunks without one are not an index that may be replaced, see load_or_empty.
    """
    manifest = chunks.sparkSession.createDataFrame([(dimension,)], "dimension int")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    _checked(chunks).write.mode(mode).partitionBy("level").parquet(f"{path}/chunks")
    saved = chunks.sparkSession.read.parquet(f"{path}/chunks")
    postings(saved).write.mode("overwrite").partitionBy("level").parquet(f"{path}/postings")
    refresh(chunks.sparkSession, path)


def refresh(spark: SparkSession, path: str) -> None:
    """Write the statistics of the saved postings anew."""
    saved = spark.read.parquet(f"{path}/postings")
    saved.groupBy("level", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").partitionBy("level").parquet(f"{path}/statistics")


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    """The saved postings: level, chunk_id, term, tf and length."""
    return spark.read.parquet(f"{path}/postings")


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The saved statistics: level, term, df and cf."""
    return spark.read.parquet(f"{path}/statistics")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """The saved chunks; an index with another dimension is refused."""
    saved = spark.read.schema("dimension int").json(f"{path}/manifest").first()[0]
    if dimension is not None and saved != dimension:
        raise ValueError(f"the index has vectors of {saved} numbers, not {dimension}")
    return spark.read.parquet(f"{path}/chunks")


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The saved chunks, or an empty table where there are none. Chunks without a manifest are an error."""
    if not exists(spark, f"{path}/chunks"):
        return spark.createDataFrame([], schema)
    return load(spark, path)


def unseen(meetings: DataFrame, indexed: DataFrame) -> DataFrame:
    """Meetings that the index has no chunk of."""
    return meetings.join(indexed.select("meeting_id").distinct(), "meeting_id", "left_anti")


def append(spark: SparkSession, chunks: DataFrame, path: str) -> None:
    """Add chunks and their postings to the saved ones; statistics are written anew from the postings."""
    _checked(chunks).write.mode("append").partitionBy("level").parquet(f"{path}/chunks")
    postings(chunks).write.mode("append").partitionBy("level").parquet(f"{path}/postings")
    refresh(spark, path)


def numbered(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Add ordinal: the chunk's place in order of chunk_id, from start on, without gaps and without one task for all."""
    sorted_ = cut(chunks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    own = sorted_.withColumn("_part", part).join(offsets, "_part")
    return own.withColumn("ordinal", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + start).drop("_id", "_part", "_before")


def with_ordinals(new: DataFrame, old: DataFrame) -> DataFrame:
    """Add to new chunks the ordinals that follow those of the old ones (column ordinal)."""
    last = old.agg(F.max("ordinal")).first()[0]
    return numbered(new, 0 if last is None else last + 1)


def inverted(chunks: DataFrame, key: str) -> DataFrame:
    """key and chunk_ids: the chunks of each meeting or entry (key meeting_id or entry_id), in order."""
    return chunks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old chunks with those of new in the place of equal chunk_ids, one row for each."""
    latest = new.dropDuplicates(["chunk_id"])
    return old.join(latest, "chunk_id", "left_anti").unionByName(latest, allowMissingColumns=True)


def quarantine(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks that can be indexed, those that cannot, and the counts of both."""
    good = F.col("chunk_id").isNotNull() & F.col("text").isNotNull() & F.col("level").isin(*LEVELS)
    good = F.coalesce(good, F.lit(False))
    return chunks.filter(good), chunks.filter(~good), chunks.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"))


def without_levels(chunks: DataFrame, *levels: str) -> DataFrame:
    """The chunks without those of some levels, or none without any named."""
    return chunks.filter(~F.col("level").isin(*map(check_level, levels))) if levels else chunks.limit(0)


def drop(spark: SparkSession, path: str, level: str | None = None) -> None:
    """Remove a level's folder or the whole index."""
    target = f"{path}/chunks/level={check_level(level)}" if level else path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stats(chunks: DataFrame, levels: list[str]) -> DataFrame:
    """level, n_chunks, n_meetings, n_embedded, has_text for each of the levels, 0 where there is nothing."""
    counted = chunks.groupBy("level").agg(F.count("*").alias("n_chunks"), F.countDistinct("meeting_id").alias("n_meetings"), F.count("embedding").alias("n_embedded"), F.bool_or(F.coalesce(F.length("text") > 0, F.lit(False))).alias("has_text"))
    wanted = chunks.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    rows = wanted.join(counted, "level", "left")
    return rows.select("level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_meetings", "n_embedded")], F.coalesce("has_text", F.lit(False)).alias("has_text"))


def health(spark: SparkSession, path: str) -> dict:
    """The session's version and what the index holds."""
    try:
        return {"status": "ok", "spark": spark.version, "chunks": load(spark, path).count()}
    except AnalysisException as e:
        return {"status": "missing", "spark": spark.version, "reason": str(e).splitlines()[0]}
