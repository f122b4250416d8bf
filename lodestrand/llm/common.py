"""What the operators of this package share: scratch tables, session settings and word arrays."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread

#: A Python worker looks at this many bytes of text at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of very long texts fits a worker; smaller settings stay as they are.

    Spark reads these settings when a query runs, so they hold for the session's later queries too.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, with the session tuned for text; small tables are dealt to all cores."""
    tune(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


class Scratch:
    """Tables in the shared folder of spark.checkpoint.dir, so that lineage ends in files every executor can read.

    Each object has a folder of its own. drop() removes a table that no later step reads. Without the setting, a local
    session uses the temporary folder; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"{tempfile.gettempdir()}/lodestrand-checkpoint"
            spark.sparkContext.setCheckpointDir(base)
        self.folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        """Write df and return the written table; with release, shuffle files of its plan go soon after."""
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        if release:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        give_back()
        return self.spark.read.schema(schema).parquet(path)

    @staticmethod
    def sweep(spark: SparkSession, hours: float) -> int:
        """Remove the folders of runs that wrote nothing for so many hours, and say how many; for use between runs.

        Tables that a result still reads stay until its reader is done, which no operator can know.
        """
        sc = spark.sparkContext
        base = sc._jvm.org.apache.hadoop.fs.Path(Scratch(spark, "sweep").folder).getParent()
        fs = base.getFileSystem(sc._jsc.hadoopConfiguration())
        old = int((time.time() - hours * 3600) * 1000)
        gone = [s.getPath() for s in (fs.listStatus(base) if fs.exists(base) else []) if s.isDirectory() and re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", s.getPath().getName()) and s.getModificationTime() < old]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def drop(self, *names: str) -> None:
        """Remove tables of this folder."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def named_apart(keep: tuple[str, ...], taken: tuple[str, ...]) -> dict[str, str]:
    """Names for columns to keep that meet none of an operator's own; none of them may be one of the result's."""
    if clash := set(keep) & set(taken):
        raise ValueError(f"columns {sorted(clash)} cannot be kept beside the result's of the same name")
    return {c: f"keep_{i}" for i, c in enumerate(keep)}


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deals(rows: DataFrame, column: str, size: int = 256 << 20) -> int:
    """Partitions for rows so that none has much more than `size` bytes of a string column; at least the session's number."""
    total = rows.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(partitions(rows.sparkSession), -(-total // size))


def give_back() -> None:
    """Give memory that earlier batches or steps used back to the system: workers are kept and share an executor's
    memory, as the driver's Python shares its own with the JVM.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about limit bytes of one string column, in order."""
    for batch in batches:
        give_back()
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts, as numbers.

    codes: the word of each position, all texts one after the other; starts: where each text begins (one more
    than there are texts); names: the distinct words.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.names = coded.dictionary
        empty = pc.index(self.names, "").as_py()
        if empty >= 0:
            full = codes != empty
            starts = np.concatenate([[0], np.cumsum(full)])[starts]
            codes = codes[full]
        self.codes, self.starts = codes, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The white space that separates words.
WORD_SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (none null) and where each begins, one more than there are texts."""
    texts = pc.cast(texts, pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def bytes_in(data: np.ndarray, chars: str | list[int]) -> np.ndarray:
    """Where the byte is one of some ASCII characters."""
    known = np.zeros(256, bool)
    known[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return known[data]


class Spans:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts, as spans of bytes.

    data: the bytes of all texts; begin and end: of each word; starts: the first word of each text, one more than
    there are texts. Words are hashed without being made: a word's hash is a polynomial over its bytes.
    """

    #: Bytes hashed at once.
    STEP = 1 << 18

    def __init__(self, texts: pa.Array):
        self.data, self.at = raw(pc.fill_null(texts, ""))
        full = ~bytes_in(self.data, WORD_SPACE)
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        # Words end where texts do.
        inner = self.at[(self.at > 0) & (self.at < len(full))]
        first[inner] = full[inner]
        last[inner - 1] = full[inner - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.starts = np.searchsorted(self.begin, self.at)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, of the word with A-Z in lower case."""
        values = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
        if lower:
            values[0x41:0x5B] = values[0x61:0x7B]
        out = np.empty(len(self.begin), np.uint64)
        cuts = np.unique(np.searchsorted(self.begin, [*range(0, len(self.data), self.STEP), len(self.data)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            base = self.begin[a]
            rolling = Rolling(values[self.data[base : self.end[b - 1]]])
            out[a:b] = rolling.spans(self.begin[a:b] - base, self.end[a:b] - self.begin[a:b])
        return out


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006 - kept between calls
    """base**0 to base**n modulo 2**64."""
    if len(known.get(base, ())) <= n:
        own = np.full(max(n + 1, 1 << 16), base, np.uint64)
        own[0] = 1
        if len(own) > Spans.STEP + (1 << 16):  # a very long item: not kept
            return np.multiply.accumulate(own)
        known[base] = np.multiply.accumulate(own)
    return known[base][: n + 1]


class Rolling:
    """Hashes of all runs of k consecutive items, for any k, from one prefix sum modulo 2**64."""

    BASE = 0xD1342543DE82EF95
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.unshift = powers(self.BACK, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items * powers(self.BASE, n)[:n], out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """The hash of items[i:i + k] for each i."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.unshift[: len(self.sums) - k])

    def spans(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hash of items[s:s + n] for each pair of s and n."""
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.unshift[starts])
