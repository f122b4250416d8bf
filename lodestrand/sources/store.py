"""A search index kept as batches of Parquet folders, which searches prune by level, term bucket and cell.

A batch adds chunks, in place of those with the same chunk_id in earlier batches, or removes chunks. Its folders are its
own, and it ends with a manifest; a batch without one is not seen, so what a failed run left is written over when the
batch is run again, and a batch that is done is never run twice. Readers see the batches since the last compaction.

Tables, each in folders by batch:

- chunks, by level: all columns of the chunks.
- postings, by level and bucket of the term: term, lists of chunk_ids that have it and their tfs, and of the scopes that
  have it and their dfs; a term has a list for each slice of rows that was indexed at once. Texts are cut into tokens
  once, for these: under no term, in a bucket of their own, they have a slice's chunks by scope, with lengths for tfs.
- docs, by level: chunk_id, scope_id, length and slice, which postings meet; sizes, by level: scope_id, n and length.
- less, by level: term, scopes and dfs of what a batch replaces or removes, below zero, if it does. sizes has such changes
  too, so sums over batches are the statistics of what is there.
- vectors, by level and cell: chunk_id, scope_id, embedding. Cells are those of the level's first batch with vectors
  (`LEAST` or more of them, fitted on `SAMPLE` for each cell at most); later batches are dealt to the same cells.
- gone: chunk_ids that the batch replaces or removes. summary: n, length and the floor of idf for each level.

scope_id is what searches of a level are limited by: the entry of chunks of the level "meeting", else the meeting.

Chunks without id, text or known level are not indexed but counted and kept apart, see failed(). Of rows with one chunk_id in a batch one
is taken. Null meetings and null vectors are allowed; such chunks are found by words alone.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from . import index
from .scratch import release

#: Buckets of terms, cells of vectors, vectors that are searched without cells, and vectors a cell is fitted on.
BUCKETS, CELLS, LEAST, SAMPLE = 32, 100, 1000, 256
#: Tokens that are listed by term at once.
TOKENS = 1 << 21
#: An idf below zero becomes EPSILON times the mean over all terms.
EPSILON = 0.25

#: A list of postings: a term, the chunks of a slice of rows that have it, and how many chunks of each scope do.
POSTINGS = "term string, slice long, chunk_ids array<{kind}>, tfs array<int>, scopes array<string>, dfs array<int>"
#: The bucket of what stands under no term.
NO_TERM = -1
MANIFEST = "dimension int, buckets int, columns string, base boolean, ok long, failed long, replaced long, batch int"


def scope_key(level: str) -> str:
    """The column that limits searches of a level."""
    return "entry_id" if level == "meeting" else "meeting_id"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def raw_idf(n: Column, df: Column) -> Column:
    """The logarithm that idf is, before the floor."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


class Store:
    """The index in a folder; see the module. Methods that take `level` check it."""

    def __init__(self, spark: SparkSession, path: str, dimension: int = 0, buckets: int = BUCKETS, cells: int = CELLS, least: int = LEAST, recreate: bool = False):
        self.spark, self.path, self.cells, self.least = spark, path.rstrip("/"), cells, least
        if recreate and index.exists(spark, f"{self.path}/manifest"):
            index.drop(spark, self.path)
        self.buckets, self.dimension, self.columns = buckets, dimension, None
        if self.manifests:
            last = self.manifests[-1]
            if dimension and last["dimension"] != dimension:
                raise ValueError(f"the index has vectors of {last['dimension']} numbers, not {dimension}")
            self.buckets, self.dimension, self.columns = last["buckets"], last["dimension"], last["columns"]

    # What is there.

    @cached_property
    def manifests(self) -> list:
        """The batches that readers see, in order."""
        if not index.exists(self.spark, f"{self.path}/manifest"):
            return []
        rows = sorted(self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect(), key=lambda r: r["batch"])
        first = max((i for i, r in enumerate(rows) if r["base"]), default=0)
        return rows[first:]

    @property
    def batches(self) -> list[int]:
        return [r["batch"] for r in self.manifests]

    def _read(self, table: str, schema: str | T.StructType, before: int | None = None) -> DataFrame:
        """All rows of the batches that readers see, also those that later batches replace."""
        return self._of(table, schema, [b for b in self.batches if before is None or b < before])

    def _of(self, table: str, schema: str | T.StructType, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/batch={b}" for b in batches])

    def live(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows (chunk_id, batch and more) that no later batch replaces or removes."""
        if not any(r["replaced"] for r in self.manifests if before is None or r["batch"] < before):
            return rows
        gone = self._read("gone", f"chunk_id {self._kind('chunk_id')}, batch int", before)
        until = gone.groupBy(F.col("chunk_id").alias("_gone")).agg(F.max("batch").alias("_until"))
        return rows.join(until, (F.col("chunk_id") == F.col("_gone")) & (F.col("batch") < F.col("_until")), "left_anti")

    def failed(self) -> DataFrame:
        """The rows that batches did not index, with their batch."""
        some = [r["batch"] for r in self.manifests if r["failed"]]
        schema = T.StructType([*self._schema(), T.StructField("batch", T.IntegerType())])
        return self._of("failed", schema, some)

    def _schema(self) -> T.StructType:
        if self.columns is None:
            raise ValueError(f"{self.path} has no batch yet")
        return T.StructType.fromDDL(self.columns)

    def _kind(self, column: str) -> str:
        fields = {f.name: f.dataType for f in self._schema()}
        return fields[column].simpleString() if column in fields else "string"

    def chunks(self, level: str | None = None) -> DataFrame:
        """The chunks of a level, or of all, with all of their columns."""
        rows = self._read("chunks", T.StructType([*self._schema(), T.StructField("batch", T.IntegerType())]))
        rows = rows if level is None else rows.filter(F.col("level") == index.check_level(level))
        return self.live(rows).drop("batch")

    def _asked(self, level: str, terms: DataFrame, few: bool) -> DataFrame:
        """The lists of some terms; only the buckets of these are read."""
        wanted = [r[0] for r in terms.select(bucket_of(F.col("term"), self.buckets)).distinct().collect()]
        rows = self._read("postings", f"{POSTINGS.format(kind=self._kind('chunk_id'))}, level string, bucket int, batch int")
        rows = rows.filter((F.col("level") == index.check_level(level)) & F.col("bucket").isin(wanted))
        distinct = terms.select("term").distinct()
        return rows.join(F.broadcast(distinct) if few else distinct, "term", "left_semi")

    def postings(self, level: str, terms: DataFrame, few: bool = True) -> DataFrame:
        """term, chunk_id, scope_id, length and tf of some terms; only the buckets of these are read."""
        found = self._asked(level, terms, few).select("term", "batch", F.inline(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("tf"))))
        # Postings of chunks that a later batch replaces meet nothing.
        return found.join(self.docs(level), ["chunk_id", "batch"]).select("term", "chunk_id", "scope_id", "length", "tf")

    def slices(self, level: str, terms: DataFrame) -> DataFrame:
        """batch, slice, term, scope_id, chunk_ids and tfs: lists of some terms, and under no term the chunks with their lengths.

        All postings of a chunk are in its slice, so slices are searched one by one and no posting is a row.
        """
        lists = self._asked(level, terms, True).select("batch", "slice", "term", F.lit(None).cast("string").alias("scope_id"), "chunk_ids", "tfs")
        of_one = F.struct("chunk_id", "length")
        docs = self.docs(level).groupBy("batch", "slice", "scope_id").agg(F.collect_list(of_one).alias("own"))
        if not any(r["replaced"] for r in self.manifests):
            docs = self._read("postings", f"{POSTINGS.format(kind=self._kind('chunk_id'))}, level string, bucket int, batch int").filter((F.col("level") == level) & (F.col("bucket") == NO_TERM))
            docs = docs.select("batch", "slice", F.col("scopes")[0].alias("scope_id"), F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("length")).alias("own"))
        docs = docs.select("batch", "slice", F.lit(None).cast("string").alias("term"), "scope_id", F.col("own.chunk_id").alias("chunk_ids"), F.col("own.length").alias("tfs"))
        return lists.unionByName(docs)

    def docs(self, level: str) -> DataFrame:
        """chunk_id, scope_id, length, slice and batch of the level's chunks."""
        rows = self._read("docs", f"chunk_id {self._kind('chunk_id')}, scope_id string, length int, slice long, level string, batch int")
        return self.live(rows.filter(F.col("level") == index.check_level(level))).drop("level")

    def counts(self, level: str) -> DataFrame:
        """term, scopes and dfs: lists whose sums by scope and term are the statistics; some are below zero."""
        return _counts(self._lists(self.manifests).filter(F.col("level") == index.check_level(level)))

    def terms(self, level: str) -> DataFrame:
        """scope_id, term and df, summed over batches."""
        rows = self.counts(level).select("term", F.inline(F.arrays_zip(F.col("scopes").alias("scope_id"), F.col("dfs").alias("df"))))
        return rows.groupBy("scope_id", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def _lists(self, seen: list) -> DataFrame:
        """level, bucket, term, scopes and dfs of some batches (rows with batch and replaced)."""
        schema = "term string, scopes array<string>, dfs array<int>, level string, bucket int, batch int"
        rows = self._of("postings", schema, [r["batch"] for r in seen])
        less = [r["batch"] for r in seen if r["replaced"]]
        return rows.unionByName(self._of("less", schema, less)) if less else rows

    def sizes(self, level: str) -> DataFrame:
        """scope_id, n (chunks) and length (tokens), summed over batches."""
        rows = self._read("sizes", "scope_id string, n long, length long, level string, batch int").filter(F.col("level") == index.check_level(level))
        return rows.groupBy("scope_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n > 0")

    def summary(self, level: str) -> tuple[int, int, float] | None:
        """Chunks and tokens of a level, and the floor of idf over all of it."""
        if not self.batches:
            return None
        last = self.batches[-1]
        row = self.spark.read.schema("level string, n long, length long, floor double").parquet(f"{self.path}/summary/batch={last}").filter(F.col("level") == index.check_level(level)).first()
        return (row["n"], row["length"], row["floor"]) if row else None

    def vectors(self, level: str, cells: list[int] | None = None) -> DataFrame:
        """chunk_id, scope_id, embedding and cell; with cells only these are read."""
        rows = self._read("vectors", f"chunk_id {self._kind('chunk_id')}, scope_id string, embedding array<float>, level string, cell int, batch int").filter(F.col("level") == index.check_level(level))
        rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
        return self.live(rows).select("chunk_id", "scope_id", "embedding", "cell")

    def centres(self, level: str) -> np.ndarray | None:
        """The cells' centres, a row each; None where the level is searched without cells."""
        place = f"{self.path}/cells/level={index.check_level(level)}"
        if not index.exists(self.spark, place):
            return None
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(place).orderBy("cell").collect()
        return np.array([r["centre"] for r in rows]) if rows else None

    def stats(self, levels: tuple[str, ...] = index.LEVELS) -> DataFrame:
        """level, n_chunks, n_tokens, n_scopes and n_embedded of each level, 0 where there is nothing."""
        if not self.batches:
            return self.spark.createDataFrame([(x, 0, 0, 0, 0) for x in levels], "level string, n_chunks long, n_tokens long, n_scopes long, n_embedded long")
        sizes = self._read("sizes", "scope_id string, n long, length long, level string, batch int").groupBy("level", "scope_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        counted = sizes.groupBy("level").agg(F.sum("n").alias("n_chunks"), F.sum("length").alias("n_tokens"), F.count_if((F.col("n") > 0) & F.col("scope_id").isNotNull()).alias("n_scopes"))
        vectors = self._read("vectors", f"chunk_id {self._kind('chunk_id')}, level string, batch int")
        embedded = self.live(vectors).groupBy("level").agg(F.count("*").alias("n_embedded"))
        wanted = self.spark.createDataFrame([(x,) for x in levels], "level string")
        rows = wanted.join(counted, "level", "left").join(embedded, "level", "left")
        return rows.select("level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_tokens", "n_scopes", "n_embedded")])

    # What changes it.

    def _write(self, rows: DataFrame, table: str, batch: int, *by: str) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{table}/batch={batch}")

    def _next(self, batch: int | None) -> int:
        last = self.batches[-1] if self.batches else -1
        if batch is not None and batch <= last:
            raise ValueError(f"batch {batch} comes after batch {last}")
        return last + 1 if batch is None else batch

    def add(self, chunks: DataFrame, batch: int | None = None) -> dict[str, int]:
        """Index chunks (level, chunk_id, meeting_id, text; entry_id and embedding if there are any), and count them.

        A chunk takes the place of that with its chunk_id. With the number of a batch that is done, nothing happens.
        """
        if batch in self.batches:
            done = next(r for r in self.manifests if r["batch"] == batch)
            return {c: done[c] for c in ("ok", "failed", "replaced")}
        batch = self._next(batch)
        if self.columns is None:
            names = [f for f in chunks.schema if f.name != "level"]
            self.columns = T.StructType([*names, T.StructField("level", T.StringType())]).toDDL()
        wanted, seen = self._schema(), Observation()
        ok = F.coalesce(F.col("chunk_id").isNotNull() & F.col("text").isNotNull() & F.col("level").isin(*index.LEVELS), F.lit(False))

        def own(rows: DataFrame) -> DataFrame:
            return index.quarantine(rows)[0].select(*[F.col(f.name) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])

        # The chunks are computed once, and again only if some cannot be indexed or have the id of others.
        self._write(own(chunks.observe(seen, F.count_if(~ok).alias("failed"))), "chunks", batch, "level")
        ids = self.spark.read.schema(wanted).parquet(f"{self.path}/chunks/batch={batch}").agg(F.count("*"), F.countDistinct("chunk_id")).first()
        if ids[0] != ids[1]:
            self._write(own(chunks).dropDuplicates(["chunk_id"]), "chunks", batch, "level")
        release(self.spark)
        failed = seen.get.get("failed", 0)
        if failed:
            self._write(index.quarantine(chunks)[1], "failed", batch)
        new = self.spark.read.schema(wanted).parquet(f"{self.path}/chunks/batch={batch}")
        earlier = self.live(self._read("chunks", T.StructType([*wanted, T.StructField("batch", T.IntegerType())]), batch), batch)
        replaced = self._write_gone(earlier.join(new.select("chunk_id"), "chunk_id", "left_semi"), batch)
        self._write_parts(new, batch, replaced)
        return self._finish(batch, new.count(), failed, replaced)

    def remove(self, chunk_ids: DataFrame | None = None, levels: tuple[str, ...] = (), batch: int | None = None) -> dict[str, int]:
        """Take chunks out, by chunk_id or whole levels, and count them."""
        batch = self._next(batch)
        wanted = self._schema()
        rows = self.live(self._read("chunks", T.StructType([*wanted, T.StructField("batch", T.IntegerType())])))
        out = rows.filter(F.col("level").isin(*map(index.check_level, levels))) if levels else rows.limit(0)
        if chunk_ids is not None:
            out = out.unionByName(rows.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi"))
        replaced = self._write_gone(out, batch)
        none = self.spark.createDataFrame([], wanted)
        self._write(none, "chunks", batch, "level")
        self._write_parts(none, batch, replaced)
        return self._finish(batch, 0, 0, replaced)

    def compact(self) -> dict[str, int]:
        """One batch with what is there; readers no longer see earlier ones, whose folders sweep() removes."""
        batch = self._next(None)
        self._write(self.chunks(), "chunks", batch, "level")
        new = self.spark.read.schema(self._schema()).parquet(f"{self.path}/chunks/batch={batch}")
        self._write_gone(new.limit(0), batch)
        self._write_parts(new, batch, 0)
        return self._finish(batch, new.count(), 0, 0, base=True)

    def sweep(self) -> None:
        """Remove the folders of batches that readers no longer see, manifests first."""
        first = self.batches[0] if self.batches else 0
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for table in ("manifest", "chunks", "postings", "docs", "less", "sizes", "vectors", "gone", "failed", "summary"):
            root = hadoop.Path(f"{self.path}/{table}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for folder in fs.listStatus(root) if fs.exists(root) else []:
                name = folder.getPath().getName()
                if name.startswith("batch=") and int(name.removeprefix("batch=")) < first:
                    fs.delete(folder.getPath(), True)

    def _write_parts(self, new: DataFrame, batch: int, replaced: int) -> None:
        """Everything but the chunks themselves, from a batch's chunks and the number of those that it takes out."""
        kind = self._kind("chunk_id")
        scope = F.when(F.col("level") == "meeting", F.col("entry_id") if "entry_id" in new.columns else F.lit(None)).otherwise(F.col("meeting_id")).cast("string")

        def listed(rows: DataFrame) -> DataFrame:
            words = rows.select("level", "chunk_id", scope.alias("scope_id"), tokens(F.col("text")).alias("tokens"))
            return words.mapInArrow(_listed(self.buckets), f"{POSTINGS.format(kind=kind)}, level string, bucket int")

        # Large buckets are split and small ones put together at run time; a file is in the order of its terms.
        self._write(listed(new).hint("rebalance", "level", "bucket").sortWithinPartitions("level", "bucket", "term"), "postings", batch, "level", "bucket")
        release(self.spark)
        whole = self._of("postings", f"{POSTINGS.format(kind=kind)}, level string, bucket int, batch int", [batch]).filter(F.col("bucket") == NO_TERM)
        docs = whole.select("level", "slice", F.col("scopes")[0].alias("scope_id"), F.inline(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("length"))))
        self._write(docs.select("level", "chunk_id", "scope_id", "length", "slice"), "docs", batch, "level")
        docs = self._of("docs", f"chunk_id {kind}, scope_id string, length int, level string, batch int", [batch])
        sizes = docs.groupBy("level", "scope_id").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
        if replaced:
            gone = self.spark.read.schema(f"chunk_id {kind}").parquet(f"{self.path}/gone/batch={batch}")
            old = self.live(self._read("chunks", T.StructType([*self._schema(), T.StructField("batch", T.IntegerType())]), batch).join(gone, "chunk_id", "left_semi"), batch)
            less = listed(old).select("level", "bucket", "term", "scopes", F.transform("dfs", lambda n: -n).alias("dfs"), F.when(F.col("term").isNull(), -F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n)).alias("length"))
            self._write(less, "less", batch, "level", "bucket")
            release(self.spark)
            less = self._of("less", "scopes array<string>, dfs array<int>, length long, level string, bucket int, batch int", [batch]).filter(F.col("bucket") == NO_TERM)
            sizes = sizes.unionByName(less.groupBy("level", F.col("scopes")[0].alias("scope_id")).agg(F.sum(F.col("dfs")[0]).alias("n"), F.sum("length").alias("length")))
        self._write(sizes, "sizes", batch, "level")
        self._write_vectors(new, scope, batch)

    def _write_vectors(self, new: DataFrame, scope: Column, batch: int) -> None:
        if "embedding" not in new.columns:
            empty = self.spark.createDataFrame([], f"chunk_id {self._kind('chunk_id')}, scope_id string, embedding array<float>, level string, cell int")
            return self._write(empty, "vectors", batch, "level", "cell")
        vector = F.col("embedding").cast("array<float>")
        if self.dimension:
            wrong = F.raise_error(F.concat(F.lit(f"a vector of other than {self.dimension} numbers: chunk "), F.col("chunk_id").cast("string")))
            vector = F.when(F.size("embedding") == self.dimension, vector).otherwise(wrong.cast("array<float>"))
        rows = new.filter(F.col("embedding").isNotNull()).select("chunk_id", scope.alias("scope_id"), vector.alias("embedding"), "level")
        known = {}
        for r in rows.groupBy("level").count().collect():
            place = f"{self.path}/cells/level={r['level']}"
            if not index.exists(self.spark, f"{place}/_SUCCESS"):
                self._fit(rows.filter(F.col("level") == r["level"]), r["count"], place)
            known[r["level"]] = self.centres(r["level"])
        dealt = rows.mapInArrow(_nearest_cell(known), f"chunk_id {self._kind('chunk_id')}, scope_id string, embedding array<float>, level string, cell int")
        self._write(dealt.hint("rebalance", "level", "cell"), "vectors", batch, "level", "cell")

    def _fit(self, rows: DataFrame, n: int, place: str) -> None:
        """Write the cells of a level: a tenth of its vectors, CELLS at most, or none for few vectors."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        cells, centres = min(self.cells, max(1, n // 10)), []
        if n >= self.least:
            some = rows if n <= SAMPLE * cells else rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE * cells)
            unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(F.aggregate("embedding", F.lit(1e-300), lambda a, y: a + y.cast("double") * y.cast("double"))))
            model = KMeans(k=cells, seed=1, maxIter=10).fit(some.select(array_to_vector(unit).alias("features")))
            centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(place)

    def _write_gone(self, rows: DataFrame, batch: int) -> int:
        """Write the chunk_ids that a batch takes out, and count them."""
        self._write(rows.select("chunk_id").distinct(), "gone", batch)
        return self.spark.read.schema(f"chunk_id {self._kind('chunk_id')}").parquet(f"{self.path}/gone/batch={batch}").count()

    def _finish(self, batch: int, ok: int, failed: int, replaced: int, base: bool = False) -> dict[str, int]:
        """Write the summary and then the manifest, which makes the batch visible."""
        seen = [batch] if base else [*self.batches, batch]
        sizes = self._of("sizes", "scope_id string, n long, length long, level string", seen).groupBy("level").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        done = {r["batch"]: r for r in self.manifests} | {batch: {"batch": batch, "replaced": replaced}}
        df = _counts(self._lists([done[b] for b in seen])).groupBy("level", "term").agg(F.sum(total("dfs")).alias("df")).filter("df > 0")
        counts = df.groupBy("level", "df").agg(F.count("*").alias("terms")).join(sizes, "level")
        floor = counts.groupBy("level").agg((EPSILON * F.sum(raw_idf(F.col("n"), F.col("df")) * F.col("terms")) / F.sum("terms")).alias("floor"))
        self._write(sizes.filter("n > 0").join(floor, "level", "left").coalesce(1), "summary", batch)
        row = (self.dimension, self.buckets, self.columns, base, ok, failed, replaced)
        done = self.spark.createDataFrame([row], ", ".join(MANIFEST.split(", ")[:-1]))
        done.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch={batch}")
        self.__dict__.pop("manifests", None)
        return {"ok": ok, "failed": failed, "replaced": replaced}


def total(counts: str) -> Column:
    """The sum of an array of counts."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)


def _counts(lists: DataFrame) -> DataFrame:
    return lists.filter(F.col("bucket") != NO_TERM).select("level", "term", "scopes", "dfs")


def _listed(buckets: int):
    """A function from chunks and their tokens to lists of postings: for each term of a slice the chunks that have it.

    Under no term are all chunks of the slice by scope, with their lengths. Slices are numbered by task and place.
    """

    def steps(batches):
        """Slices of batches with about TOKENS tokens, whole rows each."""
        for batch in batches:
            at = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)) // TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for place, batch in enumerate(steps(batches)):
            name = task << 32 | place
            listed, levels, scopes = batch.column("tokens"), batch.column("level").dictionary_encode(), batch.column("scope_id").dictionary_encode()
            sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            # Chunks are numbered in the order of their scopes, so those of one scope stand side by side in a list.
            scope = scopes.indices.fill_null(len(scopes.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(scope, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            level = levels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            coded = listed.flatten().dictionary_encode()
            # The last term is none, which every chunk has as often as it has tokens.
            n, rows = len(coded.dictionary) + 1, len(sizes)
            own = level * n + n - 1
            at = np.repeat(np.arange(rows), sizes)
            # In the order of level, term, scope and chunk.
            pairs, tf = np.unique((level[at] * n + coded.indices.to_numpy(zero_copy_only=False)) * rows + number[at], return_counts=True)
            # The hash that bucket_of has.
            hashes = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
            bucket = np.append(hashes % buckets, NO_TERM)
            yield made(name, batch, pairs // rows, order[pairs % rows], tf, scope, scopes.dictionary, levels.dictionary, coded.dictionary, bucket, False)
            by_scope = np.lexsort((number, own))
            yield made(name, batch, own[by_scope], by_scope, sizes[by_scope], scope, scopes.dictionary, levels.dictionary, coded.dictionary, bucket, True)

    def made(name, batch, group, row, tf, scope, scopes, levels, terms, bucket, split):
        """Lists of chunks by group (level and term), which are in order and by scope; with split, a list for each scope."""
        n, of = len(bucket), scope[row]
        new = np.append(True, group[1:] != group[:-1])[: len(group)]
        change = new.copy()
        change[1:] |= of[1:] != of[:-1]
        inner = np.flatnonzero(change)
        first = inner if split else np.flatnonzero(new)
        starts = pa.array(np.append(first, len(group)), pa.int32())
        inside = pa.array(np.append(np.searchsorted(inner, first), len(inner)), pa.int32())
        counts = np.diff(np.append(inner, len(group)))
        values = [batch.column("chunk_id").take(pa.array(row)), pa.array(tf, pa.int32())]
        named = scopes.take(pa.array(of[inner], mask=of[inner] == len(scopes)))
        term = group[first] % n
        columns = [terms.take(pa.array(term, mask=term == n - 1)), pa.array(np.full(len(first), name), pa.int64()), *[pa.ListArray.from_arrays(starts, v) for v in values]]
        columns += [pa.ListArray.from_arrays(inside, v) for v in (named, pa.array(counts, pa.int32()))]
        columns += [levels.take(pa.array(group[first] // n)), pa.array(bucket[term], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["term", "slice", "chunk_ids", "tfs", "scopes", "dfs", "level", "bucket"])

    return run


def _nearest_cell(centres: dict[str, np.ndarray | None]):
    """A function that adds to vectors the cell with the nearest centre, 0 where there are no cells."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.zeros(batch.num_rows, np.int32)
            levels = np.array(batch.column("level").to_pylist())
            for level in set(levels):
                own = centres.get(level)
                if own is not None:
                    at = np.flatnonzero(levels == level)
                    v = batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = v / np.where(length > 0, length, 1)
                    cell[at] = np.argmin((own**2).sum(axis=1) - 2 * v @ own.T, axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("chunk_id", "scope_id", "embedding", "level")], pa.array(cell)], ["chunk_id", "scope_id", "embedding", "level", "cell"])

    return run
