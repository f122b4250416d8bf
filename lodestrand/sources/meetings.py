"""Meeting directories: metadata JSON and three markdown files, joined into one row for each meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import actions, assignee, file_number, strip, topics

PERSON = "struct<name:string,role:string,aliases:array<string>>"
ACTION = f"struct<action_id:string,task:string,assignee:{PERSON},description_plain:string,due_date:string,status:string,priority:string>"
METADATA = (
    "meeting_id string, title string, datetime string, duration_sec int, language string, source_url string, meeting_type string, "
    f"participants array<{PERSON}>, organizations array<string>, topics array<string>, keywords array<string>, "
    "related_files struct<transcript:string,meeting_summary:string,summary_embedding:string>, embedding_text_pointer string, "
    f"summary_brief string, actions array<{ACTION}>, _corrupt_record string"
)


#: The files of a meeting and what names them.
POINTERS = {"conversation_text": "related_files.transcript", "meeting_level_text": "related_files.meeting_summary", "summary_text": "related_files.summary_embedding"}


def _split_path(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.withColumn("folder", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).withColumn("file", F.regexp_extract(path, r"([^/]+)$", 1))


def texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """folder, file and the stripped text of whole files in the sub-folders con* of root."""
    rows = _split_path(spark.read.text(f"{root}/con*/", wholetext=True, pathGlobFilter=pattern))
    return rows.select("folder", "file", strip(F.col("value")).alias("text"))


def metadata(spark: SparkSession, root: str, pattern: str = "metaData*.json") -> DataFrame:
    """One row for each readable metadata file, with its folder; files that cannot be parsed are left out."""
    rows = _split_path(spark.read.schema(METADATA).json(f"{root}/con*/", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", pathGlobFilter=pattern))
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("meeting_id").isNotNull()).drop("_corrupt_record", "file")


def _pointed(rows: DataFrame, files: DataFrame, pointer: str, name: str) -> DataFrame:
    """The text that a pointer names: an exact file name first, else the same name in any case, else the same stem."""
    want = F.regexp_extract(F.col(pointer), r"([^/]+)$", 1)
    wanted = rows.select("folder", "meeting_id", want.alias("want"))
    lower = files.select("folder", "file", "text", F.lower("file").alias("key"))
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.[^.]+$", "")
    found = wanted.withColumn("stem", stem(F.col("want"))).join(lower.withColumn("stem", stem(F.col("file"))), ["folder", "stem"])
    rank = F.when(F.col("file") == F.col("want"), 0).when(F.col("key") == F.lower("want"), 1).otherwise(2)
    return found.groupBy("folder", "meeting_id").agg(F.min_by("text", F.struct(rank.alias("rank"), F.col("file"))).alias(name))


def load(spark: SparkSession, root: str) -> DataFrame:
    """One row for each meeting whose metadata and three files are all there.

    Columns are those of the metadata with conversation_text, meeting_level_text and summary_text. problems() lists the rest.
    """
    rows, files = metadata(spark, root), texts(spark, root)
    for name, pointer in POINTERS.items():
        rows = rows.join(_pointed(rows, files, pointer, name), ["folder", "meeting_id"])
    return rows


def summary_metadata(meetings: DataFrame) -> DataFrame:
    """meeting_id, datetime, participants, topics and actions (action_id, task, assignee) parsed from the summaries.

    Topics fall back to those of the metadata. An action's id is that of the first metadata action whose description is
    part of the task, which then also gives a missing assignee; else it is numbered by its place.
    """
    names = F.filter(F.transform("participants", lambda p: strip(p["name"])), lambda n: n != "")

    def named(task, i):
        known = F.try_element_at(F.filter("actions", lambda a: (F.coalesce(a["description_plain"], F.lit("")) != "") & F.contains(F.lower(task), F.lower(a["description_plain"]))), F.lit(1))
        numbered = F.concat(F.replace("meeting_id", F.lit("data"), F.lit("M")), F.format_string("-A%02d", i + 1))
        return F.struct(F.coalesce(known["action_id"], numbered).alias("action_id"), task.alias("task"), F.coalesce(assignee(task, F.col("names")), known["assignee"]["name"]).alias("assignee"))

    return meetings.withColumn("names", names).select(
        "meeting_id",
        "datetime",
        F.col("names").alias("participants"),
        topics(F.col("summary_text"), F.col("topics")).alias("topics"),
        F.transform(actions(F.col("summary_text")), named).alias("actions"),
    )


def numbered_files(spark: SparkSession, root: str, pattern: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """file_num, path and text of files anywhere below root, in an inclusive range of numbers."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    rows = rows.select(file_number(F.col("_metadata.file_path")).alias("file_num"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.col("file_num").isNotNull())
    rows = rows if start is None else rows.filter(F.col("file_num") >= start)
    return rows if end is None else rows.filter(F.col("file_num") <= end)


def paired(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with the same key, and the keys that only one side has (with the side's name); one join.

    Rows without a key are on their own side only.
    """
    joined = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), key, "full_outer")
    both = joined.filter("_left and _right").drop("_left", "_right")
    only = joined.filter("_left is null or _right is null").select(key, F.when(F.col("_left"), "left").otherwise("right").alias("side"))
    return both, only


def problems(spark: SparkSession, root: str) -> DataFrame:
    """folder, file, reason: metadata files that cannot be read, and files that a meeting names and that are not there."""
    read = spark.read.schema(METADATA).json(f"{root}/con*/", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", pathGlobFilter="metaData*.json")
    broken = _split_path(read).filter(F.col("_corrupt_record").isNotNull() | F.col("meeting_id").isNull()).select("folder", "file", F.lit("unreadable metadata").alias("reason"))
    rows, files = metadata(spark, root), texts(spark, root)
    for name, pointer in POINTERS.items():
        found = _pointed(rows, files, pointer, name).select("folder", "meeting_id")
        broken = broken.unionByName(rows.join(found, ["folder", "meeting_id"], "left_anti").select("folder", F.col(pointer).alias("file"), F.lit(f"no file for {name}").alias("reason")))
    return broken


def stitched(files: DataFrame, key: str) -> DataFrame:
    """key and the texts of its files in order of path, empty ones left out, with blank lines between.

    Where all are empty the text is null and error says so.
    """
    rows = files.withColumn("text", strip(F.col("text")))
    full = F.when(F.col("text") != "", F.struct("path", "text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(full)), lambda x: x["text"]), "\n\n")
    made = rows.groupBy(key).agg(text.alias("text"))
    return made.select(key, F.nullif("text", F.lit("")).alias("text"), F.when(F.col("text") == "", F.lit("all files are empty")).alias("error"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a golden set file."""
    case = "struct<id:string,question:string,ground_truth:string,relevant_meeting_ids:array<string>,expected_topics:array<string>>"
    return spark.read.schema(f"test_cases array<{case}>").json(path, multiLine=True).select(F.inline("test_cases"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines in a folder of their own; inputs are never rewritten."""
    df.write.mode(mode).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """A text for each key, in folders by key."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
