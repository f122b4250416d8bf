"""Batch retrieval: dense, BM25, hybrid, filtered and hierarchical top-k.

A batch of queries is a DataFrame (query_id, text, embedding); chunks are (chunk_id, meeting_id, text, embedding).
Scores are rounded to six places before ranking, so that equal hits are equal on any engine and ties go to the smaller
chunk_id.

A scope is a DataFrame (query_id, meeting_id) of allowed meetings. Distinct sets of meetings make one corpus each, so
corpus statistics are summed once for a set and not once for a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import cut
from ..sources.store import EPSILON, raw_idf

#: BM25 and fusion parameters.
K1, B, ALPHA = 1.5, 0.75, 0.6
#: Queries whose vectors one pass over the chunks holds; more queries make more passes.
QUERY_BLOCK = 4096
#: Terms of queries that are sent to every task; more of them are joined by exchange.
FEW_TERMS = 200_000
#: Pairs of corpus and meeting that are sent to every task; more of them are joined by exchange.
FEW_MEMBERS = 100_000
#: Scores, tokens or matches that a task works on at once; it holds some dozen arrays of so many numbers.
SCORES = 1 << 18
#: Tokens that a task looks up at once. Each look-up builds a table of all terms asked for, so it takes longer steps.
TOKENS = 1 << 20
#: Pairs of query and allowed meeting that one pass holds.
SCOPE_BLOCK = 2_000_000


def norm(v: Column) -> Column:
    """L2 norm of an array of numbers, summed in double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def top(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best hits of each query with their rank; ties go to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The k best chunks of each query among those that a task has seen."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.full(n, -np.inf)
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None
        self.most = max(4 * n * k, 1 << 16)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        self.key = key if self.key is None else np.concatenate([self.key, key])
        if len(self.query) > self.most:
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.key, -self.score, self.query))
        query = self.query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.query, self.score, self.key = self.query[order], self.score[order], self.key[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.query[last]] = self.score[last]


def dense(chunks: DataFrame, queries: DataFrame, k: int, scope: DataFrame | None = None, fail_open: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks with the largest cosine, exact.

    The query vectors go to every task in blocks. A task multiplies them with its chunks, keeps a running k best for
    each query and gives only these, so no pair of query and chunk becomes a row. With a scope, the chunks of a meeting
    are multiplied with the queries that may find them; a block holds QUERY_BLOCK queries and SCOPE_BLOCK pairs at most.
    """
    spark = chunks.sparkSession
    rows = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "meeting_id", "embedding")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    vectors = queries.filter(F.col("embedding").isNotNull()).select("query_id", unit(F.col("embedding")).alias("v"))
    allowed = None if scope is None else cut(scoped(queries, chunks, scope, fail_open))
    blocks = max(1, -(-vectors.count() // QUERY_BLOCK), 0 if allowed is None else -(-allowed.count() // SCOPE_BLOCK))
    found = None
    for block in range(blocks):
        here = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        own = vectors.filter(here).orderBy("query_id").collect()
        ids = [r["query_id"] for r in own]
        matrix = np.array([r["v"] for r in own], np.float64)
        at = {q: i for i, q in enumerate(ids)}
        whole, by_meeting = np.arange(len(ids)), {}
        if allowed is not None:
            for r in allowed.filter(here).collect():
                if r["query_id"] in at:
                    by_meeting.setdefault(r["meeting_id"], []).append(at[r["query_id"]])
            by_meeting = {m: np.array(q) for m, q in by_meeting.items()}
            named = np.unique(np.concatenate([np.zeros(0, np.int64), *by_meeting.values()]))
            whole = np.setdiff1d(whole, named) if fail_open else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast((ids, matrix, whole, by_meeting))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, whole, by_meeting = shared.value
            if not ids:
                return
            best = _Best(len(ids), k)

            def score(v: np.ndarray, keys: np.ndarray, asked: np.ndarray) -> None:
                step = max(1, (4 << 20) // max(len(asked), 1))
                for i in range(0, len(v), step):
                    scores = np.round(v[i : i + step] @ matrix[asked].T, 6) + 0.0
                    row, column = np.nonzero(scores >= best.least[asked])
                    best.add(asked[column], scores[row, column], keys[i + row])

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                lengths = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = v / np.where(lengths > 0, lengths, 1)
                if len(whole):
                    score(v, keys, whole)
                if by_meeting:
                    coded = batch.column("meeting_id").dictionary_encode()
                    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    order = np.argsort(codes, kind="stable")
                    edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
                    for m, a, b in zip(coded.dictionary.to_pylist(), edges[:-1], edges[1:]):
                        if m in by_meeting:
                            score(v[order[a:b]], keys[order[a:b]], by_meeting[m])
            if best.key is not None and len(best.key):
                best.prune()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query], _arrow(schema, 0)), pa.array(best.key.tolist(), _arrow(schema, 1)), pa.array(best.score, pa.float64())], ["query_id", "chunk_id", "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return top(found, k)


def _arrow(schema: str, at: int) -> pa.DataType:
    kind = schema.split(", ")[at].split()[1]
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def scoped(queries: DataFrame, chunks: DataFrame, scope: DataFrame, fail_open: bool) -> DataFrame:
    """query_id and meeting_id of allowed meetings that have chunks.

    A query without any such meeting is left out: with fail_open it searches everything, else nothing.
    """
    meetings = chunks.select("meeting_id").distinct()
    return scope.select("query_id", "meeting_id").distinct().join(meetings, "meeting_id", "left_semi")


def meeting_key(c: Column) -> Column:
    """A meeting id that is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def corpora(queries: DataFrame, chunks: DataFrame, scope: DataFrame | None, fail_open: bool) -> tuple[DataFrame, DataFrame]:
    """corpus and meeting (a key) of each distinct scope's meetings, and queries with the corpus that each one searches.

    Without a scope there is one corpus with one meeting of all chunks. Corpora are numbered, 0 is that of all chunks.
    """
    if scope is None:
        one = chunks.sparkSession.range(1).select(F.col("id").alias("corpus"), F.lit("").alias("meeting"))
        return one, queries.withColumn("corpus", F.lit(0).cast("long"))
    sets = scoped(queries, chunks, scope, fail_open).groupBy("query_id").agg(F.sort_array(F.collect_set(meeting_key(F.col("meeting_id")))).alias("meetings"))
    numbered = cut(sets.select("meetings").distinct().withColumn("corpus", F.monotonically_increasing_id() + 1))
    own = queries.join(sets.join(numbered, "meetings").select("query_id", "corpus"), "query_id", "left")
    own = cut(own.withColumn("corpus", F.coalesce("corpus", F.lit(0))) if fail_open else own.filter(F.col("corpus").isNotNull()))
    members = numbered.select("corpus", F.explode("meetings").alias("meeting"))
    if fail_open and not own.filter("corpus = 0").isEmpty():
        members = members.unionByName(chunks.select(F.lit(0).cast("long").alias("corpus"), meeting_key(F.col("meeting_id")).alias("meeting")).distinct())
    members = cut(members)
    return F.broadcast(members) if members.count() <= FEW_MEMBERS else members, own


def bm25(chunks: DataFrame, queries: DataFrame, k: int, scope: DataFrame | None = None, fail_open: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks with the largest positive BM25 score.

    idf(t) = ln(N - n + 0.5) - ln(n + 0.5); a negative one becomes EPSILON times the mean over all terms of the corpus.
    Statistics are those of the query's corpus: they are summed by meeting, and meetings are summed into corpora, so no
    text is read once for each scope. Texts are read twice: for the statistics, and to be scored in place where the
    terms of all queries are few enough to be sent to the tasks; beyond that terms and tokens are joined.
    """
    members, own = corpora(queries, chunks, scope, fail_open)
    meeting = F.lit("") if scope is None else meeting_key(F.col("meeting_id"))
    texts = chunks.select(meeting.alias("meeting"), "chunk_id", tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))

    def in_corpora(rows: DataFrame) -> DataFrame:
        return rows.withColumn("corpus", F.lit(0).cast("long")) if scope is None else rows.join(members, "meeting")

    # One pass counts the chunks that have a term, and under no term all chunks and their lengths.
    each = F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string"))))
    counted = texts.select("meeting", "length", each.alias("term")).groupBy("meeting", "term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("length"))
    counted = cut(counted)
    sizes = in_corpora(counted.filter("term is null")).groupBy("corpus").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"))
    words, held, asked = counted.filter("term is not null").select("meeting", "term", F.col("n").alias("df")), at_hand(members, FEW_MEMBERS), asked_terms(own)
    asked = weighed(asked, sizes, *by_corpus(words, asked, sizes, None if scope is None else held, in_corpora))
    terms = at_hand(asked, FEW_TERMS)
    if terms is not None and held is not None:
        return scored_in_tasks(texts, terms, held, k, queries.schema["query_id"].dataType.simpleString())
    asked = cut(asked)
    tf = texts.select("meeting", "chunk_id", "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = in_corpora(tf.repartition("chunk_id").groupBy("meeting", "chunk_id", "length", "term").agg(F.count("*").alias("tf")))
    return scored(tf, asked, k)


def at_hand(rows: DataFrame, most: int) -> list | None:
    """The rows, if there are no more than so many."""
    found = rows.limit(most + 1).collect()
    return found if len(found) <= most else None


def scored_in_tasks(rows: DataFrame, terms: list, members: list, k: int, kind: str, chunk_kind: str | None = None, made: Callable | None = None) -> DataFrame:
    """The k best chunks of each query with positive scores; terms of queries and members of corpora go to every task.

    rows: meeting, chunk_id, length, tokens, and tf if tokens are distinct. terms: weighed terms of queries, members:
    corpus and meeting, both at hand. A task adds up the scores of a batch of chunks for all queries and keeps a running
    k best, so a pair of query and chunk is no row. kind: the type of query_id. With made, a function that makes such rows
    (with tf) of the rows in the tasks, chunk_kind is the type of chunk_id.
    """
    ids, names = sorted({r["query_id"] for r in terms}), sorted({r["term"] for r in terms})
    at, place = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(names)}
    held: dict[str, list[int]] = {}
    for r in members:
        held.setdefault(r["meeting"], []).append(r["corpus"])
    key = np.array([place[r["term"]] for r in terms], np.int64)
    order = np.argsort(key, kind="stable")
    # A term's queries stand side by side.
    edges = np.searchsorted(key[order], np.arange(len(names) + 1))
    corpora = {c: i for i, c in enumerate(sorted({r["corpus"] for r in terms}))}
    corpus = np.array([corpora[r["corpus"]] for r in terms], np.int64)[order]
    query = np.array([at[r["query_id"]] for r in terms], np.int64)[order]
    weight = np.array([r["idf"] * r["times"] * (K1 + 1) for r in terms], np.float64)[order]
    mean = np.zeros(len(corpora))
    mean[corpus] = np.array([r["mean_length"] for r in terms], np.float64)[order]
    held = {m: np.array([corpora[c] for c in some if c in corpora], np.int64) for m, some in held.items()}
    shared = rows.sparkSession.sparkContext.broadcast((ids, pa.array(names, pa.string()), edges, corpus, query, weight, mean, held))
    schema = f"query_id {kind}, chunk_id {chunk_kind or rows.schema['chunk_id'].dataType.simpleString()}, score double"
    repeated = made is None and "tf" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, edges, corpus, query, weight, mean, held = shared.value
        best = _Best(len(ids), k)

        def add(batch: pa.RecordBatch, term: np.ndarray, sizes: np.ndarray) -> None:
            row = np.repeat(np.arange(batch.num_rows), sizes)
            full = term >= 0
            if repeated:
                pairs, tf = np.unique(row[full] * len(names) + term[full], return_counts=True)
                row, term = pairs // len(names), pairs % len(names)
            else:
                row, term, tf = row[full], term[full], batch.column("tf").flatten().to_numpy(zero_copy_only=False)[full]
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.float64)
            meeting = batch.column("meeting").dictionary_encode()
            inside = np.zeros((len(meeting.dictionary), len(mean)), bool)
            for i, m in enumerate(meeting.dictionary.to_pylist()):
                inside[i, held.get(m, ())] = True
            of = meeting.indices.to_numpy(zero_copy_only=False)
            scores = np.zeros(batch.num_rows * len(ids))
            low, times = edges[term], edges[term + 1] - edges[term]
            for a, b in cuts(times, SCORES):
                entry = expanded(low[a:b], times[a:b])
                at = np.repeat(np.arange(a, b), times[a:b])
                # Terms of queries that may not find the chunk do not count.
                full = inside[of[row[at]], corpus[entry]]
                entry, at = (entry, at) if full.all() else (entry[full], at[full])
                r, n = row[at], tf[at]
                part = n / (n + K1 * (1 - B + B * length[r] / mean[corpus[entry]]))
                scores += np.bincount(r * len(ids) + query[entry], part * weight[entry], len(scores))
            scores = np.round(scores, 6).reshape(batch.num_rows, -1)
            r, q = np.nonzero((scores > 0) & (scores >= best.least))
            best.add(q, scores[r, q], batch.column("chunk_id").to_numpy(zero_copy_only=False)[r])

        # Scores and tokens of a step stay below a bound.
        for batch in batches if made is None else made(batches):
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in cuts(sizes, TOKENS) if ids else []:
                part, own = batch.slice(a, b - a), sizes[a:b]
                coded = part.column("tokens").flatten().dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)
                term, ends = known[coded.indices.to_numpy(zero_copy_only=False)], np.append(0, np.cumsum(own))
                for c, d in cuts(len(ids) + own, SCORES):
                    add(part.slice(c, d - c), term[ends[c] : ends[d]], own[c:d])
            batch = part = coded = None
            pa.default_memory_pool().release_unused()
        if best.key is not None and len(best.key):
            best.prune()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query], _arrow(schema, 0)), pa.array(best.key.tolist(), _arrow(schema, 1)), pa.array(best.score, pa.float64())], ["query_id", "chunk_id", "score"])

    wanted = rows if made else rows.select("meeting", "chunk_id", "length", "tokens", *([] if repeated else ["tf"]))
    return top(wanted.mapInArrow(run, schema), k)


def few(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How terms of queries reach the tasks: sent to each of them while they are few, else by exchange."""
    return F.broadcast if asked.count() <= FEW_TERMS else lambda rows: rows


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, corpus, term and times, of queries with their corpora."""
    return queries.select("query_id", "corpus", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "corpus", "term").agg(F.count("*").alias("times"))


def floors(sizes: DataFrame, df: DataFrame) -> DataFrame:
    """corpus and floor: what a negative idf becomes."""
    # Terms with one count have one weight, so the mean over all terms is that over the counts, which are few.
    counts = df.groupBy("corpus", "df").agg(F.count("*").alias("terms")).join(sizes, "corpus")
    return counts.groupBy("corpus").agg((EPSILON * F.sum(raw_idf(F.col("n"), F.col("df")) * F.col("terms")) / F.sum("terms")).alias("floor"))


def by_corpus(words: DataFrame, asked: DataFrame, sizes: DataFrame, members: list | None, in_corpora: Callable[[DataFrame], DataFrame], listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df of the asked terms and floors, both by corpus, from words (meeting, term, df), whose rows may add up.

    Only asked terms are summed into corpora as rows. With members at hand floors are summed in tasks, so a term of a
    corpus is no row either; without, all terms are. listed: the words as lists of meetings and dfs, a row for each term.
    """
    if members is None:
        df = in_corpora(words).groupBy("corpus", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df, floors(sizes, df)
    own = words.join(asked.select("term").distinct(), "term", "left_semi")
    if listed is None:
        listed = words.groupBy("term").agg(F.collect_list(F.struct("meeting", "df")).alias("in")).select(F.col("in.meeting").alias("meetings"), F.col("in.df").alias("dfs"))
    return in_corpora(own).groupBy("corpus", "term").agg(F.sum("df").alias("df")).filter("df > 0"), floors_in_tasks(listed, members, sizes)


def floors_in_tasks(listed: DataFrame, members: list, sizes: DataFrame) -> DataFrame:
    """What floors gives, from lists of meetings and dfs, a row for each term, and corpora whose meetings are at hand."""
    n = {r["corpus"]: r["n"] for r in sizes.collect()}
    pairs = sorted((r["meeting"], r["corpus"]) for r in members if r["corpus"] in n)
    ids = sorted(n)
    at = {c: i for i, c in enumerate(ids)}
    names = sorted({m for m, _ in pairs})
    corpus = np.array([at[c] for _, c in pairs], np.int64)
    # The corpora of a meeting stand side by side; the last edge is that of unknown meetings, which have none.
    edges = np.append(np.searchsorted(np.array([m for m, _ in pairs], object), np.array([*names], object)), [len(pairs), len(pairs)]).astype(np.int64)
    shared = listed.sparkSession.sparkContext.broadcast((np.array([n[c] for c in ids], np.float64), ids, pa.array(names, pa.string()), corpus, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, ids, names, corpus, edges = shared.value
        total, terms = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for batch in batches:
            if not ids or not batch.num_rows:
                continue
            lengths = pc.list_value_length(batch.column("meetings")).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = batch.column("meetings").flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            meeting, df = known[coded.indices.to_numpy(zero_copy_only=False)], batch.column("dfs").flatten().to_numpy(zero_copy_only=False)
            low, times = edges[meeting], edges[meeting + 1] - edges[meeting]
            ends = np.append(0, np.cumsum(lengths))
            spread = np.append(0, np.cumsum(times))
            for a, b in cuts(len(ids) + np.diff(spread[ends]), SCORES):
                of = slice(ends[a], ends[b])
                row = np.repeat(np.arange(b - a), lengths[a:b])
                key = np.repeat(row * len(ids), times[of]) + corpus[expanded(low[of], times[of])]
                found = np.bincount(key, np.repeat(df[of], times[of]), (b - a) * len(ids)).reshape(b - a, -1)
                total += np.where(found > 0, np.log(size - found + 0.5) - np.log(found + 0.5), 0).sum(axis=0)
                terms += (found > 0).sum(axis=0)
        if terms.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total), pa.array(terms)], ["corpus", "total", "terms"])

    summed = listed.mapInArrow(run, "corpus long, total double, terms long").groupBy("corpus").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms"))
    return summed.filter("terms > 0").select("corpus", (EPSILON * F.col("total") / F.col("terms")).alias("floor"))


def cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive places whose sizes add up to about `most`; a larger one stands alone or ends its range."""
    at = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def expanded(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each place, so many as times says."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)


def weighed(asked: DataFrame, sizes: DataFrame, df: DataFrame, floor: DataFrame) -> DataFrame:
    """asked with idf and mean_length; terms that a corpus does not have are left out."""
    terms = asked.select("corpus", "term").distinct()
    raw = raw_idf(F.col("n"), F.col("df"))
    weights = df.join(terms, ["corpus", "term"], "left_semi").join(sizes, "corpus").join(floor, "corpus")
    weights = weights.select("corpus", "term", "mean_length", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))
    return asked.join(weights, ["corpus", "term"])


def scored(tf: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query with positive scores, from tf (corpus, chunk_id, length, term, tf) and weighed terms."""
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    parts = tf.join(few(asked)(asked), ["corpus", "term"]).select("query_id", "chunk_id", (part * F.col("times")).alias("part"))
    hits = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(hits.filter("score > 0"), k)


def normalised(hits: DataFrame) -> DataFrame:
    """Min-max of the scores of each query's hits; a list with equal scores gives zeros."""
    all_ = Window.partitionBy("query_id")
    low, high = F.min("score").over(all_), F.max("score").over(all_)
    return hits.withColumn("norm", (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """The k best of both lists by alpha times the one normalised score and 1 - alpha times the other; absent is 0."""
    v = normalised(vector_hits).select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("norm").alias("vector_norm"))
    t = normalised(text_hits).select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("norm").alias("bm25_norm"))
    both = v.join(t, ["query_id", "chunk_id"], "full_outer")
    score = alpha * F.coalesce("vector_norm", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25_norm", F.lit(0.0))
    return top(both.withColumn("score", F.round(score, 6)), k).select("query_id", "chunk_id", "rank", "vector_score", "bm25_score", F.col("score").alias("hybrid_score"))


def hybrid(
    chunks: DataFrame, queries: DataFrame, k: int, alpha: float = ALPHA, scope: DataFrame | None = None, fail_open: bool = False, candidates: int | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """Dense and BM25 lists of `candidates` hits (k if not given) fused into k.

    vectors (chunk_id, meeting_id, embedding) may stand in a table of their own, so that no text moves to meet them.
    """
    n = candidates or k
    return fuse(dense(chunks if vectors is None else vectors, queries, n, scope, fail_open), bm25(chunks, queries, n, scope, fail_open), k, alpha)


def by_entry(chunks: DataFrame, queries: DataFrame, entries: DataFrame, k: int, alpha: float = ALPHA, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid search among chunks whose entry_id is allowed (query_id, entry_id); nothing allowed finds nothing."""
    keyed = lambda rows: rows if rows is None else rows.drop("meeting_id").withColumnRenamed("entry_id", "meeting_id")
    return hybrid(keyed(chunks), queries, k, alpha, entries.withColumnRenamed("entry_id", "meeting_id"), fail_open=False, vectors=keyed(vectors))


def hierarchical(
    metadata: DataFrame, summaries: DataFrame, entries: DataFrame, queries: DataFrame, k: tuple[int, int, int] = (5, 10, 10), alpha: float = ALPHA, vectors: tuple[DataFrame | None, DataFrame | None, DataFrame | None] = (None, None, None)
) -> DataFrame:
    """Three levels in one plan: meetings by metadata, summaries of these, entries that the summaries refer to.

    summaries have references (an array of entry ids); entries have entry_id. A query that finds nothing at a level
    has no rows at the levels below. Rows: query_id, level, chunk_id, rank, hybrid_score. The levels' vectors may stand
    in tables of their own, as in hybrid; those of entries have entry_id.
    """
    # Each level's hits are few and used several times below, so they are computed once.
    first = cut(hybrid(metadata, queries, k[0], alpha, vectors=vectors[0]))
    meetings = first.join(metadata.select("chunk_id", "meeting_id"), "chunk_id").select("query_id", "meeting_id").distinct()
    meetings = cut(meetings)
    on = cut(queries.join(meetings.select("query_id").distinct(), "query_id", "left_semi"))
    second = cut(hybrid(summaries, on, k[1], alpha, meetings, fail_open=True, vectors=vectors[1]))
    named = second.join(summaries.select("chunk_id", "references"), "chunk_id")
    wanted = cut(named.select("query_id", F.explode("references").alias("entry_id")).distinct())
    third = by_entry(entries, on.join(wanted.select("query_id").distinct(), "query_id", "left_semi"), wanted, k[2], alpha, vectors[2])
    parts = [hits.select("query_id", F.lit(level).alias("level"), "chunk_id", "rank", "hybrid_score") for level, hits in (("metadata", first), ("summary", second), ("meeting", third))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ivf(chunks: DataFrame, queries: DataFrame, k: int, probes: int = 1, least: int = 1000, seed: int = 1) -> DataFrame:
    """Approximate dense search: chunks are dealt to k-means cells and each query looks into its nearest cells.

    The number of cells is a tenth of the chunks, at most 100; fewer than `least` chunks are searched exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.filter(F.col("embedding").isNotNull())
    n = rows.count()
    if n < least:
        return dense(chunks, queries, k)
    vectors = rows.select("chunk_id", unit(F.col("embedding")).alias("embedding")).withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=min(100, max(1, n // 10)), seed=seed, maxIter=10).fit(vectors)
    centres = np.array(model.clusterCenters())
    cells = model.transform(vectors).select("chunk_id", F.col("prediction").cast("string").alias("meeting_id"), "embedding")
    shared = chunks.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = np.argsort((shared.value**2).sum(axis=1) - 2 * v @ shared.value.T, axis=1, kind="stable")[:, :probes]
                ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), own.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.ravel().astype(str), pa.string())], ["query_id", "meeting_id"])

    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", unit(F.col("embedding")).alias("v"))
    scope = asked.mapInArrow(nearest, f"query_id {queries.schema['query_id'].dataType.simpleString()}, meeting_id string")
    return dense(cells, queries, k, scope, fail_open=False)


def summary_only(summaries: DataFrame, queries: DataFrame, k: int = 10, alpha: float = ALPHA) -> DataFrame:
    """The summary level of the hierarchical search alone: hybrid search over all summaries."""
    return hybrid(summaries, queries, k, alpha)
