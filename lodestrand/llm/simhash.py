"""SimHash near-dedup: multi-index hashing.

A fingerprint has a bit where more than half of the document's shingles have it in their 64-bit hash. Fingerprints are
cut into segments, and there is a table of fingerprints for each segment. Two fingerprints that differ in r bits or
fewer are within a small Hamming ball of each other in some segment, so a fingerprint looks up the values of the ball
around each of its segments, and what it meets is verified on all 64 bits. A ball holds the segment's own value and, in
the segments that need them, values with bits taken away: of two fingerprints, that with the larger value looks up the
other, so no pair is met from both sides.

Equal fingerprints are one node from the start, with the smallest id of their documents. Before the balls are looked up,
each node is tested against a few leaders of each of its buckets, drawn by hash, and what is linked becomes one
component. Afterwards only nodes outside their bucket's largest component look up all others, and those inside look up
the nodes outside; nodes of one component are never compared. Both sides of a bucket are packed into lists of bounded
length, and each list meets each list of the other side in a row of its own, so neither a bucket nor a ball is one task.
Who differs from all members of a bucket in too many bits that they have in common, or all lack, is not packed.

Words are runs of characters other than white space, with A-Z in lower case; a null text is empty. A document with fewer
words than a shingle is one shingle; without words its fingerprint is zero, which is linked like any other. Repeated rows
are equal fingerprints. A row with a null id takes part; a component has the smallest id that is not null, and null if it
has none. An empty table gives an empty result. Other columns of the documents are not read.

What grows faster than the input: fingerprints of one bucket in different components are compared with each other, 64
bits at a time. With N different fingerprints, a bucket of 21 bits has N / 2**21 of these by chance, so there are two
segments of 32 bits (some 280 values looked up for each) from five million fingerprints on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Spans, partitions, slices
from .components import components

#: Shingle length, seed of the shingles' hash, and bits that linked fingerprints may differ in.
K, SEED, RADIUS = 4, 42, 4
#: Leaders of a bucket; entries of a packed list; pairs that a task verifies at once.
LEADERS, LIST, PAIRS = 8, 2048, 1 << 21


def fingerprint(shingles: list[memoryview]) -> int:
    """The bits that are set in over half of the shingles' hashes, as a signed number; zero without shingles."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        own = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i : i + (1 << 16)]], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0])


def shingles(words: Spans, i: int, lower: np.ndarray) -> list[memoryview]:
    """The shingles of text i, words joined by one space, as parts of one buffer."""
    a, b = words.starts[i], words.starts[i + 1]
    if a == b:
        return []
    # Each word moves to the place it has when one space stands between words.
    begin, end = words.begin[a:b], words.end[a:b]
    lengths = end - begin
    place = np.cumsum(lengths + 1) - lengths - 1
    said = np.full(place[-1] + lengths[-1], 0x20, np.uint8)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    said[np.repeat(place, lengths) + at] = lower[words.data[np.repeat(begin, lengths) + at]]
    said, ends = memoryview(said), (place + lengths).tolist()
    if len(ends) < K:
        return [said]
    return [said[s:e] for s, e in zip(place.tolist(), ends[K - 1 :])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the 64 bits as a signed number, for every row."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Spans(batch.column("text"))
            own = [fingerprint(shingles(words, i, lower)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def plan(segments: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """First bit, width and radius of the ball for each segment.

    If every segment differed in more bits than its ball allows, all 64 would differ in more than `radius`.
    """
    each, rest = divmod(radius, segments)
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a, each if i <= rest else each - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i <= rest or each]


def masks(width: int, radius: int) -> list[int]:
    """The bits in which values of the ball around a segment's value differ from it."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def segments_for(n: int, radius: int = RADIUS) -> int:
    """How many segments cost least for n fingerprints: a row for each lookup, and pairs by chance, most in packed rows."""

    def cost(segments: int) -> float:
        looked = [(w, sum(comb(w, i) for i in range(r + 1)) / (2 if r else 1)) for _, w, r in plan(segments, radius)]
        return n * sum(m + 5 * m * n / 2**w for w, m in looked)

    return min((2, 3, 4), key=cost)


def _bits(c: str, first: int, width: int):
    return F.shiftrightunsigned(F.col(c), first).bitwiseAND(F.lit((1 << width) - 1))


def _entries(nodes: DataFrame, segments: int) -> DataFrame:
    """A row for each node and segment: segment, value and the node's columns."""
    own = F.array(*[F.struct(F.lit(i).alias("segment"), _bits("fp", a, w).alias("value")) for i, (a, w, _) in enumerate(plan(segments))])
    return nodes.withColumn("entry", F.explode(own)).select("entry.segment", "entry.value", *nodes.columns)


def _looked_up(nodes: DataFrame, segments: int) -> DataFrame:
    """A row for each value that a node looks up besides its own: segment, value and the node's columns.

    Of each pair of values only the larger looks up the other.
    """
    parts = []
    for i, (a, w, r) in enumerate(plan(segments)):
        own = _bits("fp", a, w)
        near = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks(w, r)[1:]]), lambda m: own.bitwiseXOR(m)), lambda v: v < own)
        parts += [nodes.withColumn("value", F.explode(near)).select(F.lit(i).alias("segment"), "value", *nodes.columns)] if r else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leader_links(nodes: DataFrame, segments: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between nodes and leaders of their buckets: for each salt the member with the least hash."""
    entries = _entries(nodes.select("fp"), segments)
    leaders = [F.min(F.struct(F.xxhash64("fp", F.lit(s)).alias("h"), "fp")).alias(f"l{s}") for s in range(LEADERS)]
    several = entries.groupBy("segment", "value").agg(F.count("*").alias("m"), *leaders).filter("m > 1")
    several = several.select("segment", "value", F.array_distinct(F.array(*[F.col(f"l{s}.fp") for s in range(LEADERS)])).alias("leaders"))
    near = F.filter("leaders", lambda v: (v != F.col("fp")) & (F.bit_count(v.bitwiseXOR(F.col("fp"))) <= radius))
    return entries.join(several, ["segment", "value"]).select(F.col("fp").alias("u"), F.explode(near).alias("v")).distinct()


def _forest(u: np.ndarray, v: np.ndarray, ends: dict[int, int]) -> list[tuple[int, int]]:
    """The links that join two trees of what `ends` has joined so far, which it then joins too."""

    def root(x: int) -> int:
        while ends.setdefault(x, x) != x:
            ends[x] = x = ends[ends[x]]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            ends[ra] = rb
            out.append((a, b))
    return out


def verify(met: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs (u, v) of labels that some pair of fingerprints links, of the lists asks and answers in a row.

    Of the links of a row, those that close a circle are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("asks", "answers"):
                lists = batch.column(c)
                sizes = pc_lengths(lists)
                flat = lists.flatten()
                sides.append((sizes, np.cumsum(sizes) - sizes, flat.field("fp").to_numpy(zero_copy_only=False), flat.field("label").to_numpy(zero_copy_only=False)))
            (n, at, fp, label), (m, to, other, theirs) = sides
            pairs = np.cumsum(n * m)
            cuts = np.unique(np.searchsorted(pairs, [*range(0, int(pairs[-1]) if len(pairs) else 0, PAIRS), 1 << 62]))
            links: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = np.repeat(np.arange(a, b), n[a:b] * m[a:b])
                place = np.arange(len(rows)) - np.repeat(np.cumsum(n[a:b] * m[a:b]) - n[a:b] * m[a:b], n[a:b] * m[a:b])
                i, j = at[rows] + place // m[rows], to[rows] + place % m[rows]
                near = np.flatnonzero((np.bitwise_count((fp[i] ^ other[j]).view(np.uint64)) <= radius) & (label[i] != theirs[j]))
                ends: dict[int, int] = {}
                links += _forest(label[i[near]], theirs[j[near]], ends)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    return met.select("asks", "answers").mapInArrow(run, "u long, v long").distinct()


def pc_lengths(lists: pa.ListArray) -> np.ndarray:
    """The number of entries of each list, none of them null."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def met_lists(nodes: DataFrame, segments: int, radius: int = RADIUS) -> DataFrame:
    """asks and answers: packed lists of (fp, label) that may hold links between components.

    inside: whether those who ask are of the bucket's largest component; then only nodes outside it answer.
    """
    spark = nodes.sparkSession
    entries = _entries(nodes, segments)
    by_label = entries.groupBy("segment", "value", "label").agg(F.count("*").alias("m"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("each"))
    buckets = by_label.groupBy("segment", "value").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"), F.bit_or("some").alias("some"), F.bit_and("each").alias("each"))
    buckets = buckets.select("segment", "value", F.col("top.label").alias("largest"), F.col("m").alias("all"), (F.col("m") - F.col("top.m")).alias("others"), "some", "each")
    of_bucket = entries.join(buckets, ["segment", "value"]).withColumn("outside", F.col("label") != F.col("largest"))
    # No member is nearer than this: bits that none of them has, and bits that each of them has.
    least = F.bit_count(F.col("fp").bitwiseAND(F.bitwise_not("some"))) + F.bit_count(F.bitwise_not("fp").bitwiseAND(F.col("each")))
    looked = _looked_up(nodes, segments).join(buckets, ["segment", "value"]).filter(least <= radius).withColumn("outside", F.col("label") != F.col("largest"))
    asks = of_bucket.filter("outside").unionByName(looked.filter("outside or others > 0")).withColumn("inside", ~F.col("outside"))
    key = ["segment", "value", "inside"]
    counted = asks.groupBy(*key).agg(F.count("*").alias("asking"), F.first("all").alias("all"), F.first("others").alias("others"))
    pieces = lambda c: F.ceil(c / LIST).cast("int")
    sized = counted.select(*key, pieces(F.col("asking")).alias("blocks"), pieces(F.when(F.col("inside"), F.col("others")).otherwise(F.col("all"))).alias("chunks"))

    def packed(rows: DataFrame, of: str, seed: int, name: str) -> DataFrame:
        dealt = rows.join(sized, key).withColumn(of, F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(f"{of}s")).cast("int"))
        # Lists of one bucket are packed in different tasks: the join has put the bucket into one.
        return dealt.repartition(partitions(spark), *key, of).groupBy(*key, of).agg(F.collect_list(F.struct("fp", "label")).alias(name), F.first("blocks").alias("blocks"), F.first("chunks").alias("chunks"))

    both = of_bucket.withColumn("inside", F.explode(F.when(F.col("outside"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    left = packed(asks, "block", 1, "asks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = packed(both, "chunk", 2, "answers").select(*key, "chunk", "answers")
    return left.join(right, [*key, "chunk"]).repartition(partitions(spark))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """doc_id, fp, fingerprint (hexadecimal) and component_id for every row of docs; segments are counted out if not given.

    Tables of a step go when the last step that reads them has ended.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    signed = scratch.save(fingerprints(docs, id_col, text_col), "signed")
    nodes = scratch.save(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = segments or segments_for(nodes.count(), radius)
    first = scratch.save(leader_links(nodes, parts, radius), "first-links")
    labels = scratch.save(components(first, scratch, "first"), "first-labels")
    labelled = nodes.select("fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = scratch.save(labelled, "labelled")
    # Components found so far are nodes of what is left.
    rest = scratch.save(verify(met_lists(labelled, parts, radius), radius), "rest-links")
    merged = components(rest, scratch, "rest").select(F.col("node").alias("label"), F.col("label").alias("component"))
    of_node = nodes.join(labelled, "fp").join(merged, "label", "left").withColumn("component", F.coalesce("component", "label"))
    least = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.save(of_node.join(least, "component").select("fp", "component_id"), "named")
    scratch.drop("nodes", "first-links", "first-labels", "labelled", "rest-links")
    found = signed.join(named, "fp")
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
