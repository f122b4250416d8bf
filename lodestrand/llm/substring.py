"""Substring dedup: repeated-phrase automata.

A window of `length` consecutive words is removed from every place where it stands if it stands in more than one.

Documents are dealt at random to shards of bounded size. Passes over the shards, with exchanges of numbers between:

1. Anchors. Each window picks the least hash among its shorter runs of words, so equal windows pick equal anchors. An
   anchor that stands in one place only belongs to no repeated window; this rules out most of the corpus by counting
   about one anchor for ten words.
2. Confirmation. Each shard lists its different windows with a recurring anchor, as passages of up to 64 windows with
   their words, and windows are counted by hash over all shards.
3. Location. For each shard the passages that may stand in it are gathered, from whichever shard holds them, and
   compiled into the shard's Aho-Corasick automaton over word numbers; all its documents are streamed through it.

One automaton over all passages would grow with the corpus; a shard's holds the passages that its own windows' hashes
name, so it is no larger than the shard. Its words are blocks of half a window's length: any window of a passage holds
a whole block, so passages are found from any place on, with no more nodes than they have words. From a block that the
automaton finds the match is extended to the window and its words are compared with those of another place; only then
are they removed (a window that only its own shard holds must be found there twice). So hashes name what to look for
and never decide: a unique window stays whatever its hash. A repeated window is missed if its hash is also that of a
window with other words (one in 2**64 for each of them).

Null text has no words; empty texts keep nothing and lose nothing. Repeated rows are documents of their own, so their
windows repeat; null ids stay null. An empty table gives an empty result. Columns to keep may have any name but those
of the result: their values travel under names of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, Spans, Words, give_back, named_apart, partitions, slices

#: Bytes of text in a shard and in a bucket of shards, words in an anchor, and windows in a passage.
SHARD_BYTES, BUCKET_BYTES, ANCHOR, PASSAGE = 2 << 20, 256 << 20, 8, 64
#: The result's columns beside those kept.
RESULT = ("doc_id", "text", "kept", "n_words", "n_removed")


class Windows:
    """The windows of a slice of texts: hashes, anchors, and where they start.

    bits: the bits of a window's hash in use, all but in tests.
    """

    def __init__(self, texts: pa.Array, length: int, anchor: int = ANCHOR, bits: int = 64):
        self.texts, self.words = texts, Spans(texts)
        self.length, self.anchor, self.bits = length, min(anchor, length), bits
        self.rolling = Rolling(self.words.hashes())
        starts = self.words.starts
        self.of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(self.of) - length + 1
        # Starts of windows that end in the text in which they begin.
        self.at = np.flatnonzero(self.of[:n] == self.of[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hash and the place of its least run of anchor words, the leftmost of equal ones."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least = self.rolling.runs(self.anchor)
        place = np.arange(len(least))
        span, width = 1, self.length - self.anchor + 1
        while span < width:
            step = min(span, width - span)
            left = least[:-step] <= least[step:]
            least = np.where(left, least[:-step], least[step:])
            place = np.where(left, place[:-step], place[step:])
            span += step
        return least[self.at], place[self.at]

    def hashes(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return self.rolling.runs(self.length)[self.at] & np.uint64((1 << self.bits) - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs that begin where new is true."""
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new)) - 1


def passages(windows: Windows, candidate: np.ndarray) -> pa.Table:
    """The different candidate windows of a shard, in passages of neighbouring ones.

    A passage has the number k, its words as text, the hash of each window and whether it stands twice here.
    """
    chosen = np.flatnonzero(candidate)
    keys, first, counts = np.unique(windows.hashes()[chosen], return_index=True, return_counts=True)
    order = np.argsort(first)
    at, keys, many = chosen[first[order]], keys[order], counts[order] > 1
    starts = windows.at[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(starts) != 1) | (windows.of[starts[1:]] != windows.of[starts[:-1]])
    begin, end = _runs(new) if len(at) else (np.zeros(0, np.int64),) * 2
    # Long runs are cut: a window's place in its run, modulo a passage's length.
    new |= (np.arange(len(at)) - np.repeat(begin, end - begin + 1)) % PASSAGE == 0
    begin, end = _runs(new) if len(at) else (begin, end)
    words, data = windows.words, windows.words.data.tobytes()
    a, b = words.begin[starts[begin]], words.end[starts[end] + windows.length - 1]
    cuts = pa.array(np.append(begin, len(at)).astype(np.int32))
    texts = pa.array([data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(a.tolist(), b.tolist())], pa.string())
    return pa.table({"k": pa.array(np.arange(len(begin))), "said": texts, "hashes": pa.ListArray.from_arrays(cuts, _signed(keys)), "many": pa.ListArray.from_arrays(cuts, pa.array(many))})


def locate(windows: Windows, said: pa.Array, masks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which words of the windows' texts stand under a window of a passage, by the automaton of the passages' blocks.

    said: the passages' words; masks: for each passage a bit for each of its windows to look for; own: whether the
    passage was taken from these texts, so that its windows must be found twice.
    """
    length, removed = windows.length, np.zeros(len(windows.of), bool)
    theirs = Windows(said, length, bits=windows.bits)
    if not len(theirs.at) or not len(windows.at):
        return removed
    # The passages' repeated windows, in order of hash. Passages are runs, so a window's place is its start's.
    place = theirs.at - theirs.words.starts[theirs.of[theirs.at]]
    wanted = (masks.view(np.uint64)[theirs.of[theirs.at]] >> place.astype(np.uint64)) & np.uint64(1) == 1
    at = theirs.at[wanted]
    if not len(at):
        return removed
    keys, first = np.unique(theirs.hashes()[wanted], return_index=True)
    # Blocks stand at the start of each run of repeated windows and at every block's length from there.
    block = (length + 1) // 2
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (theirs.of[at[1:]] != theirs.of[at[:-1]])
    begin, end = _runs(new)
    run_start = np.repeat(at[begin], end - begin + 1)
    ahead = -(at - run_start) % block

    hashes = windows.hashes()
    named = _among(hashes, keys)
    some = np.zeros(len(windows.words.at) - 1, bool)
    some[windows.of[windows.at[named]]] = True
    if not some.any():
        return removed
    rows = np.flatnonzero(some)
    # One numbering of words for documents and passages. Only documents with a named window are numbered.
    numbered = Words(pa.concat_arrays([pc.cast(x, pa.large_string()) for x in (windows.texts.take(pa.array(rows)), said)]))
    codes, bounds = numbered.codes, numbered.starts
    base = bounds[len(rows)]

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    of_place: dict[int, int] = {}
    for start in np.unique(at + ahead).tolist():
        words = tuple(codes[base + start : base + start + block].tolist())
        of_place[start] = automaton.get(words, None) or len(automaton) + 1
        automaton.add_word(words, of_place[start])
    automaton.make_automaton()
    found = np.zeros(len(windows.of) + block, np.int64)  # by start: the block's number
    for row, a, b in zip(rows.tolist(), bounds[: len(rows)].tolist(), bounds[1 : len(rows) + 1].tolist()):
        begins = windows.words.starts[row]
        for last, number in automaton.iter(tuple(codes[a:b].tolist())):
            found[begins + last + 1 - block] = number

    # Each named window: its passage's block must have been found where the window would hold it, and all words be equal.
    at_doc = windows.at[named]
    one = first[np.searchsorted(keys, hashes[named])]
    block_of = np.fromiter((of_place[x] for x in (at + ahead).tolist()), np.int64, len(at))
    met = found[at_doc + ahead[one]] == block_of[one]
    at_doc, at_said = at_doc[met], at[one[met]]
    shift = np.zeros(len(some), np.int64)
    shift[rows] = bounds[: len(rows)] - windows.words.starts[rows]
    from_doc, from_said = at_doc + shift[windows.of[at_doc]], at_said + base
    equal = np.ones(len(at_doc), bool)
    for i in range(length):
        equal &= codes[from_doc + i] == codes[from_said + i]
    which = one[met]
    times = np.bincount(which[equal], minlength=len(at))
    equal &= times[which] > own[theirs.of[at[which]]]
    cover = np.zeros(len(removed) + 1, np.int64)
    cover[at_doc[equal]] += 1
    cover[at_doc[equal] + length] -= 1
    return np.cumsum(cover[:-1]) > 0


def kept_words(words: Spans, removed: np.ndarray) -> pa.Array:
    """For each text its words that are not removed, joined by one space."""
    own = np.flatnonzero(~removed)
    edges = np.zeros(len(words.data) + 2, np.int8)
    of = np.searchsorted(words.starts, own, side="right") - 1
    last = np.ones(len(own), bool)
    last[:-1] = of[1:] != of[:-1]
    # The byte behind a word is white space if a word follows in the text.
    edges[words.begin[own]] += 1
    edges[words.end[own] + ~last] -= 1
    inside = np.cumsum(edges[:-2], dtype=np.int8) > 0
    behind = words.end[own[~last]]
    data = words.data.copy()
    data[behind] = 0x20
    offsets = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[words.at]
    return pa.LargeStringArray.from_buffers(len(words.at) - 1, pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def _shards(docs: DataFrame, id_col: str, text_col: str, keep: dict[str, str], scratch: Scratch) -> DataFrame:
    """The documents in a table bucketed by shard, so that later passes read them without an exchange.

    The number of buckets grows with the text. The table is known to the returned frame alone, not to the catalog.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in keep.items()])
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(100_000, max(partitions(spark), -(-total // BUCKET_BYTES)))
    shards = max(n, -(-total // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).repartition(n, "shard")
    name = f"shards_{uuid.uuid4().hex}"
    dealt.sortWithinPartitions("shard").write.bucketBy(n, "shard").option("path", f"{scratch.folder}/shards").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def repeated(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """doc_id, text without the words of repeated windows, kept, n_words and n_removed, and the columns named in keep.

    Text from which nothing is removed is unchanged in `text`; `kept` is the kept words joined by one space in any
    case. A column to keep must not have the name of one of these.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    named = named_apart(keep, RESULT)
    table = _shards(docs, id_col, text_col, named, scratch)

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in slices(batches):
            own = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                yield int(own[a]), batch.slice(a, b - a)

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, batch in by_shard(batches):
            least, place = Windows(batch.column("text"), length).anchors()
            if not len(least):
                continue
            new = np.ones(len(place), bool)
            new[1:] = np.diff(place) != 0
            keys, counts = np.unique(least[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), _signed(keys), pa.array(counts.astype(np.int32))], ["shard", "hash", "n"])

    def find_windows(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        give_back()
        known = np.sort(anchors.column("hash").to_numpy().view(np.uint64)) if anchors.num_rows else np.zeros(0, np.uint64)
        windows = Windows(_one(docs, "text"), length, bits=bits)
        made = passages(windows, _among(windows.anchors()[0], known))
        number = docs.column("shard")[0].as_py() if docs.num_rows else 0
        place = np.int64(number) << np.int64(32) | made.column("k").to_numpy() * PASSAGE
        return pa.table({"shard": pa.array(np.full(made.num_rows, number, np.int32)), "place": pa.array(place.astype(np.int64)), "said": made.column("said"), "hashes": made.column("hashes"), "many": made.column("many")})

    def remove(docs: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        texts = _one(docs, "text")
        windows = Windows(texts, length, bits=bits)
        masks, own = (known.column(c).to_numpy() if known.num_rows else np.zeros(0, np.int64) for c in ("mask", "own"))
        removed = locate(windows, _one(known, "said"), masks, own.astype(np.int64))
        words = windows.words
        counts = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.starts])
        kept = pc.cast(kept_words(words, removed), pa.string())
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "text": pc.if_else(pa.array(counts == 0), texts, kept),
                "kept": kept,
                "n_words": pa.array(np.diff(words.starts).astype(np.int64)),
                "n_removed": pa.array(counts.astype(np.int64)),
                **{k: docs.column(k) for k in named.values()},
            }
        )

    found = scratch.save(table.select("shard", "text").mapInArrow(find_anchors, "shard int, hash long, n int"), "anchors")
    often = found.groupBy("hash").agg(F.sum("n").alias("all")).filter("all > 1").select("hash")
    anchors = found.join(often, "hash").select("shard", "hash")
    listed = table.select("shard", "text").groupBy("shard").cogroup(anchors.groupBy("shard"))
    listed = scratch.save(listed.applyInArrow(find_windows, "shard int, place long, said string, hashes array<long>, many array<boolean>"), "passages")
    scratch.drop("anchors")

    # A window has the place of its passage plus its number in it, so places tell shard and passage.
    each = listed.select("place", F.posexplode(F.arrays_zip("hashes", "many")).alias("i", "w")).select(F.col("w.hashes").alias("hash"), (F.col("place") + F.col("i")).alias("at"), F.when(F.col("w.many"), 2).otherwise(1).alias("n"))
    same = Window.partitionBy("hash")
    each = each.select("hash", "at", F.sum("n").over(same).alias("all"), F.min("at").over(same).alias("first"), F.max("at").over(same).alias("last")).filter("all > 1")
    # A window is compared with the first place that has its hash, the first with the last.
    other = each.select("at", F.when(F.col("at") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"))
    wanted = other.groupBy(F.shiftright("at", 32).cast("int").alias("shard"), F.expr(f"other & ~{PASSAGE - 1}L").alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(other & {PASSAGE - 1} as int))")).alias("mask"))
    wanted = scratch.save(wanted, "wanted")
    gathered = wanted.join(listed.select("place", "said"), "place").select("shard", "said", "mask", (F.shiftright("place", 32) == F.col("shard")).cast("int").alias("own"))
    fields = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in named.items()]).schema.fields
    result = ", ".join(["doc_id long, text string, kept string, n_words long, n_removed long", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])
    cut = table.groupBy("shard").cogroup(gathered.groupBy("shard")).applyInArrow(remove, result)
    return cut.select(*RESULT, *[F.col(k).alias(c) for c, k in named.items()])


def _one(table: pa.Table, column: str) -> pa.Array:
    """A string column as one array."""
    chunks = table.column(column).chunks if table.num_rows else []
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.string())


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x are in a sorted array."""
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of what repeated() gives."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
