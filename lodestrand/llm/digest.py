"""Document fingerprints: canonical exact digest.

A text is normalised (NFKC, case folding, NFKC again), white space runs become one space, ends are trimmed, and the
UTF-8 bytes of that canonical form are hashed with 128-bit xxhash. Equal fingerprints with equal canonical bytes are
the same document.

Null text counts as empty, whose canonical form is empty. Rows are ordered by id, then by a hash of the text, so ties
and repeated rows have a fixed order; null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, deals, slices


def canonical(text: str) -> bytes:
    """The bytes that two texts share when they differ only in form, case and white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    """1 if the fingerprints and then the canonical bytes are equal, else 0: an exact digest has nothing between."""
    return float(a[0] == b[0] and a[1] == b[1])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and the canonical form's byte length of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            canons = [canonical(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(digest, canons), pa.string()), pa.array(map(len, canons), pa.int64())], ["doc_id", "fingerprint", "n_bytes"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id long, fingerprint string, n_bytes long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None, hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """doc_id, fingerprint, group_id (the smallest id with the same canonical bytes) and group_size, a row for each pair
    of id and fingerprint; group_id is null where a group has null ids only.

    Canonical forms are summed by digest and bytes, before rows move, so a group of any size costs a row for each task.
    A digest with one form is a group. Where several forms share a digest, bytes tell the groups of its rows apart.
    prints: doc_id and fingerprint of docs, if known.
    """
    scratch = Scratch(docs.sparkSession, "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            canons = [canonical(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(hashed, canons), pa.string()), pa.array(canons, pa.binary())], ["doc_id", "fingerprint", "canon"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id long, fingerprint string, canon binary")
    forms = rows.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    by_digest = forms.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.min("group_id").alias("group_id"), F.sum("group_size").alias("group_size"))
    by_digest = scratch.save(by_digest, "digests")
    named = (rows if prints is None else prints).select("doc_id", "fingerprint").distinct()
    groups = named.join(by_digest.filter("forms = 1").drop("forms"), "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size")
    shared = by_digest.filter("forms > 1").select("fingerprint")
    if shared.isEmpty():
        return groups
    several = rows.join(shared, "fingerprint", "left_semi").groupBy("doc_id", "fingerprint", "canon").agg(F.count("*").alias("n"))
    apart = several.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.sum("n").alias("group_size"))
    return groups.unionByName(several.join(apart, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "group_id", "group_size"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


PAIRS = "part int, last boolean, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document in order of ids.

    Documents are dealt by ranges of ids and sorted within them. A task pairs each row with the next one that it
    reads; only a task's first and last rows are paired afterwards, over two rows for each task.
    """

    def compare(text: str, following: str) -> list:
        canon, other, after = canonical(text), canonical(edited(text, following)), canonical(following)
        own, changed, behind = (digest(canon), canon), (digest(other), other), (digest(after), after)
        sha = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest()
        return [len(text), sha, own[0], changed[0], likeness(own, changed), likeness(own, behind)]

    def rows_of(found: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        names = [f.split()[0] for f in PAIRS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in slices(batches):
            found = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                if held is None:
                    first = [part, False, key, *[None] * 6, text]
                else:
                    found.append([part, False, held[0], *compare(held[1], text), None])
                held = key, text
            if found:
                yield rows_of(found)
        if held is not None:
            yield rows_of([first, [part, True, held[0], *[None] * 6, held[1]]])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist())
            if found := [[0, False, key, *compare(text, following), None] for key, text, following in pairs]:
                yield rows_of(found).select([2, 3, 4, 5, 6, 7, 8])

    out = [f.split()[0] for f in PAIRS.split(", ")][2:9]
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(deals(rows, "text"), *keys).sortWithinPartitions(*keys)
    paired = Scratch(spark, "fingerprints").save(dealt.mapInArrow(run, PAIRS), "pairs")
    # Two rows for each task: a task's last row is followed by the next task's first, the very last by the very first.
    # Only their places are put in order; the texts join them.
    ends = paired.filter("text is not null").select("part", "last", "doc_id", "text")
    first, last = ends.filter("not last"), ends.filter("last")
    order = Window.orderBy("part")
    lowest = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = last.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), lowest))
    joined = last.join(following, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    schema = ", ".join(PAIRS.split(", ")[2:9])
    return paired.filter("text is null").select(*out).unionByName(joined.select("doc_id", "text", "following").mapInArrow(join_ends, schema))


def with_groups(docs: DataFrame) -> DataFrame:
    """What compare_with_next gives, and group_id and group_size of the documents with the same canonical bytes."""
    found = Scratch(docs.sparkSession, "fingerprints").save(compare_with_next(docs), "compared")
    groups = exact_groups(docs, prints=found)
    match = found["doc_id"].eqNullSafe(groups["doc_id"]) & (found["fingerprint"] == groups["fingerprint"])
    return found.join(groups, match).select(found["*"], "group_id", "group_size")
