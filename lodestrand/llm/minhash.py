"""MinHash near-dedup: circulant MinHash.

A document is its set of distinct 5-word shingles. Two permutations make the whole signature: the first scatters the
shingles over a circle, the second, shifted by one place for each coordinate, gives the values whose least one is the
coordinate. So a shingle's values for all coordinates are one stretch of a table. Coordinates are banded; documents
that share a band are candidates, and links are confirmed on the full sets.

Documents with equal sets are one class from the start. Classes of a bucket are not paired with each other: each is
tested against one leader, twice (the second time each component found so far against one leader), and only classes
that still stand in different components are compared among themselves, on signatures and in blocks; pairs whose
signatures agree often enough for the threshold go to the exact test. So large groups of near copies cost a test for
each member, and no link between components is left untested.

With bands of 6 of 384 coordinates, a pair at the threshold shares no band with probability 4e-6. The signature test
lets pairs through from 4.5 standard errors below the threshold.

Null and empty texts have an empty set and are linked with nothing; fewer words than a shingle are one shingle.
Repeated rows are equal sets. A row with a null id takes part; its component has the smallest id that is not null,
and if there is none the id stays null (kept is then true for these rows). An empty table gives an empty result. Other
columns of the documents are not read.

What grows faster than the input: members of a bucket that are in different components after two rounds are compared
among themselves, as any two of them may be linked. Texts with a likeness of 0.5 to 0.7 to very many others (one
template) make such buckets; their signatures meet in blocks, the square of their number, and their texts only where
signatures agree.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, Spans, mix, slices
from .components import components

#: Shingle length, places on the circle (a power of 2), bands and coordinates in a band.
K, CIRCLE, BANDS, ROWS = 5, 1 << 22, 64, 6
#: Members of a bucket that one group compares with the others, and shingles of their texts; four times that answer.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


@functools.cache
def permutation(seed: int = 7) -> np.ndarray:
    """The second permutation, with as many of its first values behind its last as there are coordinates."""
    own = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
    return np.concatenate([own, own[: BANDS * ROWS]])


def scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation of the circle, at the shingles' hashes modulo its size."""
    x = shingles & np.uint64(CIRCLE - 1)
    x = (x * np.uint64(0x2545F491) + np.uint64(0x3C6EF)) & np.uint64(CIRCLE - 1)
    x ^= x >> np.uint64(11)
    return ((x * np.uint64(0x9E3779B1)) & np.uint64(CIRCLE - 1)).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set of shingle hashes."""
    table = np.lib.stride_tricks.sliding_window_view(permutation(), BANDS * ROWS)
    at = np.sort(scatter(shingles))
    best = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(at), 1024):
        np.minimum(best, table[at[i : i + 1024]].min(axis=0), out=best)
    return best


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band, with the band's number in it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.view(np.int64)


def shingle_sets(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Spans(texts)
    rolling = Rolling(words.hashes(lower=True))
    runs = rolling.runs(k)
    out = []
    for a, b in zip(words.starts[:-1], words.starts[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(rolling.spans(np.array([a]), np.array([b - a])) if b > a else np.zeros(0, np.uint64))
    return out


SIGNED = "doc_id long, text_hash long, n_shingles long, own string, bands array<long>, low binary"


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: set size, a 128-bit digest of the set, band hashes, and the low bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in slices(batches):
            sizes, digests, bands, low = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                digest = xxhash.xxh3_128_hexdigest(s.tobytes())
                if digest not in known:
                    if len(known) >= 5000:
                        known.clear()
                    sig = signature(s) if len(s) else None
                    known[digest] = (band_hashes(sig), (sig & 0xFF).astype(np.uint8).tobytes()) if len(s) else (None, None)
                sizes.append(len(s))
                digests.append(digest)
                bands.append(known[digest][0])
                low.append(known[digest][1])
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SIGNED.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for big in batches:
            for batch in slices(iter([big]), "text"):
                own = shingle_sets(batch.column("text"))
                links = []
                for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())):
                    if v != last[0]:
                        last = v, shingle_sets(batch.column("other").slice(i, 1))[0]
                    both = len(np.intersect1d(own[i], last[1], assume_unique=True))
                    if 100 * both >= percent * (len(own[i]) + len(last[1]) - both):
                        links.append((u, v))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    mine = texts.select(F.col("node").alias("u"), "text")
    others = texts.select(F.col("node").alias("v"), F.col("text").alias("other"))
    return pairs.join(mine, "u").join(others, "v").select("u", "v", "text", "other").mapInArrow(run, "u long, v long").distinct()


def compare(members: DataFrame, percent: int) -> DataFrame:
    """For each group (bucket, block, chunk) the nodes that the exact test needs, a row each.

    members: bucket, block, chunk, node, label, asks, outside, n, bands, low. Who asks is compared with those who
    answer; its row lists as partners, best first, those with another label whose signature agrees often enough. A
    pair counts in the first band that both share, and two who ask are compared once.
    """
    least = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        node, label, n = (group.column(c).to_numpy() for c in ("node", "label", "n"))
        asks, outside = (group.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "outside"))
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        wanted: dict[int, list[int]] = {}
        for i in np.flatnonzero(asks):
            other = ~asks & (label != label[i]) & ~(outside & (node >= node[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            part = np.flatnonzero(other)
            alike = np.concatenate([(low[x] == low[i]).mean(axis=1) for x in np.array_split(part, len(part) // BLOCK + 1)])
            alike = (alike - 1 / 256) / (1 - 1 / 256)
            part, alike = part[alike >= least], alike[alike >= least]
            mine = bands[i][(bands[part] == bands[i]).argmax(axis=1)] == bucket
            part = part[mine][np.argsort(-alike[mine], kind="stable")]
            if len(part):
                wanted[int(node[i])] = [int(at) for at in part]
        answers = sorted({int(node[at]) for part in wanted.values() for at in part} - wanted.keys())
        nodes = [*wanted, *answers]
        partners = [[int(node[at]) for at in part] for part in wanted.values()] + [[]] * len(answers)
        theirs = [[int(label[at]) for at in part] for part in wanted.values()] + [[]] * len(answers)
        numbers = [pa.array([k.as_py()] * len(nodes), kind) for k, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
        return pa.table([*numbers, pa.array(nodes, pa.int64()), pa.array(partners, pa.list_(pa.int64())), pa.array(theirs, pa.list_(pa.int64()))], names=["bucket", "block", "chunk", "node", "partners", "theirs"])

    return members.groupBy("bucket", "block", "chunk").applyInArrow(run, "bucket long, block int, chunk int, node long, partners array<long>, theirs array<long>")


def confirm_groups(asked: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """A link (u, v) for each node that asks and each label among its partners, the first that the full sets confirm.

    Texts move once for each group that needs them, not once for each pair.
    """

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        sets = dict(zip(nodes, shingle_sets(group.column("text").combine_chunks())))
        us, vs = [], []
        for node, partners, labels in zip(nodes, group.column("partners").to_pylist(), group.column("theirs").to_pylist()):
            linked = set()
            for other, label in zip(partners, labels):
                if label not in linked:
                    a, b = sets[node], sets[other]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        linked.add(label)
                        us.append(max(node, other))
                        vs.append(min(node, other))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return asked.join(texts, "node").groupBy("bucket", "block", "chunk").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component) and kept for every row of docs.

    Besides text_hash and stays: true for the rows with the least (doc_id, text_hash) of their component, null ids
    last, and for those with empty sets. Tables of a step go when the last step that reads them has ended.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.save(sign(docs, id_col, text_col), "signed")
    rows = scratch.save(signed.select("doc_id", "text_hash", "n_shingles", "own"), "rows")
    # A class has an id of its own; it is written once and then read, so the ids stay.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    classes = signed.filter("n_shingles > 0").groupBy("own").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    scratch.drop("signed")
    names = scratch.save(classes.select("node", "own", "first"), "names")
    bucketed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    several = bucketed.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).filter("m > 1").drop("m")
    members = scratch.save(several, "members")
    # Only classes that share a bucket go on with their signatures and texts.
    met = scratch.save(classes.join(members.select("node").distinct(), "node", "left_semi").drop("own"), "met")
    scratch.drop("classes")

    firsts = met.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    match = source["doc_id"].eqNullSafe(firsts["doc_id"]) & (source["text_hash"] == firsts["text_hash"])
    texts = scratch.save(source.join(firsts, match).select("node", "text").dropDuplicates(["node"]), "texts")

    labels, links = None, None
    for step in ("first", "second"):
        pairs = _leader_pairs(members, labels, percent)
        found = scratch.save(confirm(pairs, texts, percent), f"{step}-links")
        links = found if links is None else links.union(found)
        labels = scratch.save(components(links, scratch, step), f"{step}-labels")
    apart = _apart(members, labels, met)
    found = scratch.save(confirm_groups(compare(apart, percent), texts, percent), "last-links")
    labels = scratch.save(components(links.union(found), scratch, "last"), "last-labels")
    scratch.drop("members", "met", "texts", "first-links", "second-links", "last-links", "first-labels", "second-labels")

    of_class = names.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_class.groupBy("label").agg(F.min("first").alias("least"))
    by_class = of_class.join(smallest, "label").select("own", "least")
    named = rows.join(by_class, "own", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash"))
    named = named.withColumn("component_id", component).withColumn("stays", (F.col("n_shingles") == 0) | first)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "stays")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _leader_pairs(members: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """For each component its best pair with the leader of a bucket: the one they share most buckets with.

    The leader is the bucket's least label, by its least member.
    """
    own = _labelled(members, labels)
    leaders = own.groupBy("bucket").agg(F.min(F.struct("label", "node", "n")).alias("lead"), F.max("label").alias("top")).filter("top > lead.label").select("bucket", "lead")
    near = own.join(leaders, "bucket").filter("label <> lead.label").filter(100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
    counted = near.groupBy("label", "node", F.col("lead.node").alias("leader")).agg(F.count("*").alias("shared"))
    best = counted.groupBy("label").agg(F.max_by(F.struct(F.col("node").alias("u"), F.col("leader").alias("v")), F.struct("shared", -F.col("leader"), -F.col("node"))).alias("best"))
    return best.select("best.u", "best.v").distinct()


def _apart(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, dealt to groups of bounded size.

    The members outside the bucket's largest component ask, and all members answer. Who asks is dealt to blocks, who
    answers to chunks, and each block meets each chunk; a bucket of usual size is one group.
    """
    own = _labelled(members, labels)
    sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("size").alias("m"), F.sum("n").alias("n"), F.max(F.struct("size", "label", "n")).alias("top")).filter("labels > 1")

    def pieces(rows, shingles, times: int):
        return F.ceil(F.greatest(rows / F.lit(times * BLOCK), shingles / F.lit(times * BLOCK_SHINGLES))).cast("int")

    blocks = pieces(F.col("m") - F.col("top.size"), F.col("n") - F.col("top.n"), 1)
    buckets = buckets.select("bucket", F.col("top.label").alias("largest"), blocks.alias("blocks"), pieces(F.col("m"), F.col("n"), 4).alias("chunks"))
    dealt = own.join(buckets, "bucket").withColumn("outside", F.col("label") != F.col("largest"))

    def place(n: str, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    answer = dealt.withColumn("asks", F.lit(False)).withColumn("chunk", place("chunks", 1)).withColumn("block", every("blocks"))
    ask = dealt.filter("outside").withColumn("asks", F.lit(True)).withColumn("block", place("blocks", 2)).withColumn("chunk", every("chunks"))
    spread = answer.unionByName(ask).join(classes.select("node", "bands", "low"), "node")
    return spread.select("bucket", "block", "chunk", "node", "label", "asks", "outside", F.col("n").cast("long").alias("n"), "bands", "low")
