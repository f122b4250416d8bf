"""Chunking: paragraph numbers, sections, entries, bullet packing and recursive splitting, by level.

Sections and entries are cut within a row, so no line moves between tasks; paragraph numbers are windows over
(document, line number). The two splitters fold over a text from left to right; they are Arrow functions from a text to
an array of texts.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT = 1200


#: A line that begins an entry, and a stripped line that begins a section.
ENTRY_HEAD = r"[ \r\t]*-[^\S\n]*\*\*(?:Topic Title|Responsible Person):\*\*"
SECTION_HEAD = r"##[^\S\n]+[^\n]"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 0) and line of each line; a null text has none."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def paragraph_index(rows: DataFrame, key: str) -> DataFrame:
    """Add is_start and paragraph (running number from 1) to lines.

    A line starts a paragraph if it has content, follows a blank line or nothing, and is neither a heading nor tagged.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    blank = T.strip(F.col("line")) == ""
    after_blank = F.lag(blank, 1, True).over(order)
    start = after_blank & ~blank & ~F.startswith(T.strip(F.col("line")), F.lit("#")) & ~F.contains("line", F.lit("[#P"))
    flagged = rows.withColumn("is_start", start)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("paragraph", F.sum(F.col("is_start").cast("int")).over(running).cast("int"))


def tagged(rows: DataFrame, key: str) -> DataFrame:
    """key and the text with `[#P001] ` before each paragraph start, behind its indentation, from numbered lines."""
    said = F.regexp_replace("line", r"^\s+", "")
    indented = F.concat(F.repeat(F.lit(" "), F.length("line") - F.length(said)), F.format_string("[#P%03d] ", "paragraph"), said)
    line = F.when(F.col("is_start"), indented).otherwise(F.col("line"))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def entries(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, entry_no and entry: a text cut before each `- **Topic Title:**` or `- **Responsible Person:**` line.

    What stands before the first is an entry of its own.
    """
    cut = docs.select(key, F.posexplode(F.split(F.col(text), rf"\n(?={ENTRY_HEAD})")).alias("place", "entry"))
    return cut.select(key, (F.col("place") + 1).alias("entry_no"), "entry")


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_no, section and body: a markdown text cut at `## ` headers.

    Lines are stripped and blank ones dropped, the rest joined by two spaces and a line break; what comes before the
    first header is section Unknown, if it has content.
    """
    full = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: T.strip(x)), lambda x: x != "")
    rows = docs.select(key, F.array_join(full, "\n").alias("full"))
    # What a row gives once is computed before its pieces become rows, so that no piece carries the whole text.
    pieces = rows.select(key, F.col("full").rlike(rf"^{SECTION_HEAD}").cast("int").alias("first"), F.split("full", rf"\n(?={SECTION_HEAD})").alias("pieces"))
    cut = pieces.select(key, "first", F.posexplode("pieces").alias("place", "piece"))
    head = F.col("piece").rlike(rf"^{SECTION_HEAD}")
    title = T.strip(F.regexp_replace(F.substring_index("piece", "\n", 1), r"^##\s+", ""))
    below = F.regexp_extract("piece", r"^[^\n]*\n([\s\S]*)$", 1)
    body = F.replace(F.when(head, below).otherwise(F.col("piece")), F.lit("\n"), F.lit("  \n"))
    named = cut.select(key, (F.col("place") + F.col("first")).alias("section_no"), F.when(head, title).otherwise(F.lit("Unknown")).alias("section"), body.alias("body"))
    return named.filter("body <> ''")


def _segments(text: str) -> tuple[list[str], list[bool]]:
    """Bullets with the lines below them, and the lines before the first bullet."""
    rows = text.split("\n")
    starts = [i for i, row in enumerate(rows) if row.strip().startswith("- ")]
    cuts, known = sorted({0, *starts, len(rows)}), set(starts)
    return ["\n".join(rows[a:b]) for a, b in zip(cuts, cuts[1:])], [a in known for a in cuts[:-1]]


def pack_bullets(text: str | None, limit: int = LIMIT) -> list[str]:
    """Chunks of whole segments whose lengths sum to the limit at most; each begins with the last bullet before it.

    The bullet carried over may push a chunk past the limit, as may one long segment. Without bullets the text is one
    chunk; a blank text has none.
    """
    if not text or not text.strip():
        return []
    parts, bullets = _segments(text)
    if not any(bullets):
        return [text]
    chunks: list[list[int]] = [[]]
    size, carried = 0, None
    for i, part in enumerate(parts):
        if chunks[-1] and size + len(part) > limit:
            chunks.append([] if carried is None else [carried])
            size = sum(len(parts[j]) for j in chunks[-1])
        chunks[-1].append(i)
        size += len(part)
        carried = i if bullets[i] else carried
    return ["\n".join(parts[j] for j in chunk) for chunk in chunks]


def split_recursively(text: str | None, size: int = 800, overlap: int = 120, marks: tuple[str, ...] = ("\n\n", "\n", "；", "，", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest mark that helps, with overlap between neighbours."""
    if not text or not text.strip():
        return []
    mark = next((m for m in marks if m == "" or m in text), "")
    finer = marks[marks.index(mark) + 1 :] if mark else ()
    parts = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    held: deque[str] = deque()
    length = 0  # of the held parts, joined

    def joined_with(part: str) -> int:
        return length + len(part) + (len(mark) if held else 0)

    def flush() -> None:
        if held and (joined := mark.join(held).strip()):
            out.append(joined)

    for part in parts:
        if len(part) > size and finer:
            flush()
            held.clear()
            length = 0
            out += split_recursively(part, size, overlap, finer)
            continue
        if held and joined_with(part) > size:
            flush()
            while held and (length > overlap or joined_with(part) > size):
                first = held.popleft()
                length -= len(first) + (len(mark) if held else 0)
        length = joined_with(part)
        held.append(part)
    flush()
    return out


def bullet_chunks(text: Column, limit: int = LIMIT) -> Column:
    """pack_bullets as a column of arrays."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_bullets(t, limit))

    return run(text)


def recursive_chunks(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """split_recursively as a column of arrays."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap))

    return run(text)


def metadata_text(brief: Column, descriptions: Column) -> Column:
    """`Brief Summary: …`, if there is one, and each description that is not empty, a line each."""
    listed = F.filter(descriptions, lambda d: F.coalesce(d, F.lit("")) != "")
    return F.concat_ws("\n", F.concat(F.lit("Brief Summary: "), F.nullif(brief, F.lit(""))), F.when(F.size(listed) > 0, F.array_join(listed, "\n")))


def _dated(text: Column) -> Column:
    return F.concat(text, F.lit("\n\nMeeting: "), F.coalesce("title", F.lit("")), F.lit("\nDate: "), F.coalesce("datetime", F.lit("None")))


def summary_level(meetings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks of summary_text with the ids and references of each chunk."""
    parts = meetings.select("meeting_id", "title", "datetime", F.posexplode(F.filter(bullet_chunks(F.col("summary_text"), limit), lambda x: T.strip(x) != "")).alias("n", "part"))
    return parts.select(
        "meeting_id",
        F.lit("summary").alias("level"),
        F.concat("meeting_id", F.lit("_summary_"), F.col("n").cast("string")).alias("chunk_id"),
        _dated(F.col("part")).alias("text"),
        T.summary_ids(F.col("part")).alias("summary_ids"),
        T.references(F.col("part")).alias("references"),
    )


def meeting_level(meetings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks of meeting_level_text: sections, entries in them, and parts of entries longer than the limit.

    Every part of an entry has the whole entry's id, reference and paragraphs.
    """
    named = meetings.select(F.struct("meeting_id", "title", "datetime").alias("of"), "meeting_level_text")
    cut = sections(named, "of", "meeting_level_text").withColumn("at", F.struct("of", "section_no", "section"))
    listed = entries(cut, "at", "body").withColumn("entry_key", T.entry_id(F.col("entry"))).withColumn("reference", T.entry_reference(F.col("entry")))
    parts = F.when(F.length("entry") > limit, bullet_chunks(F.col("entry"), limit)).otherwise(F.array("entry"))
    exploded = listed.filter(T.strip(F.col("entry")) != "").select("at", "entry_no", "entry_key", "reference", F.posexplode(parts).alias("part_no", "part"))
    order = Window.partitionBy("at.of.meeting_id").orderBy("at.section_no", "entry_no", "part_no")
    numbered = exploded.withColumn("n", F.row_number().over(order) - 1).select("at.of.*", "at.section", "entry_key", "reference", "n", "part")
    paragraphs = F.coalesce(T.paragraph_range(F.col("reference")), F.array().cast("array<string>"))
    return numbered.select(
        "meeting_id",
        F.lit("meeting").alias("level"),
        F.concat("meeting_id", F.lit("_meeting_"), F.col("n").cast("string")).alias("chunk_id"),
        _dated(F.col("part")).alias("text"),
        "section",
        F.col("entry_key").alias("entry_id"),
        "reference",
        paragraphs.alias("paragraph_indices"),
    )


def metadata_level(meetings: DataFrame) -> DataFrame:
    """One chunk a meeting: the brief summary and the descriptions of its actions."""
    descriptions = F.transform("actions", lambda a: a["description_plain"])
    return meetings.select("meeting_id", F.lit("metadata").alias("level"), F.concat("meeting_id", F.lit("_metadata")).alias("chunk_id"), metadata_text(F.col("summary_brief"), F.coalesce(descriptions, F.array().cast("array<string>"))).alias("text"))


def fine_level(meetings: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of the transcript itself."""
    parts = meetings.select("meeting_id", F.posexplode(recursive_chunks(F.col("conversation_text"), size, overlap)).alias("n", "text"))
    return parts.select("meeting_id", F.lit("chunk").alias("level"), F.concat("meeting_id", F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), "text")


def all_levels(meetings: DataFrame, only_summary: bool = False, include_chunk_level: bool = False, limit: int = LIMIT) -> DataFrame:
    """The enabled levels in one table; columns that a level lacks are null."""
    found = summary_level(meetings, limit)
    if not only_summary:
        found = found.unionByName(metadata_level(meetings), allowMissingColumns=True).unionByName(meeting_level(meetings, limit), allowMissingColumns=True)
    if include_chunk_level:
        found = found.unionByName(fine_level(meetings), allowMissingColumns=True)
    return found
