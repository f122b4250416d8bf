"""Language ID: word-first backoff.

A text's words (runs of letters, lower case) are scored for each language. A word that training saw has its log
relative frequency in each language. An unseen word falls back to character n-grams of the word between boundary
marks, the longest first: the mean over those of one length that training saw, and if there is none, the next shorter
length. A text has the language with the largest sum; its score is that language's share after a softmax.

The model is fitted on a sample of labelled rows bounded by sample_chars for each language; every text is then
scored whole. Null text and text without letters give `und` with score 0, as does a model without any language.
Ties go to the language first in order of code points. Repeated rows are scored alike; null ids stay null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, named_apart, slices

LONGEST = 5
UNKNOWN = "und"


def remainder(key: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Languages, and for words and n-grams the row of log relative frequencies by language."""

    languages: list[str]
    words: dict[str, int]
    pieces: dict[str, int]
    rows: np.ndarray
    most_kept: int = 200_000

    def __post_init__(self):
        self.kept: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], least: int = 2) -> Model:
        """From (language, word, count) of the sample; words seen fewer than `least` times count in n-grams only."""
        languages = sorted({lang for lang, _, _ in counts}, key=lambda x: x.encode())
        at = {lang: i for i, lang in enumerate(languages)}
        tables = [[Counter() for _ in languages] for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            own = at[lang]
            tables[0][own][word] += n
            for k in range(1, LONGEST + 1):
                table = tables[k][own]
                for gram in grams(word, k):
                    table[gram] += n
        index, rows, total = [{}, {}], [], 0
        for k, table in enumerate(tables):
            sums = Counter()
            for own in table:
                sums.update(own)
            kept = sorted(x for x, n in sums.items() if n >= least)
            place = {x: i for i, x in enumerate(kept)}
            matrix = np.full((len(kept), len(languages)), 0.5)
            for j, own in enumerate(table):
                found = [(place[x], n) for x, n in own.items() if x in place]
                if found:
                    matrix[[i for i, _ in found], j] += [n for _, n in found]
            rows.append(np.log(matrix / (matrix.sum(axis=0) + 1e-9)) if kept else matrix)
            index[k > 0] |= {x: total + i for i, x in enumerate(kept)}
            total += len(kept)
        return cls(languages, *index, np.concatenate(rows).astype(np.float32))

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language."""
        if (known := self.words.get(word)) is not None:
            return self.rows[known]
        if (row := self.kept.get(word)) is None:
            row = self.unseen(word)
            if len(self.kept) >= self.most_kept:
                self.kept.clear()
            self.kept[word] = row
        return row

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            if found := [self.pieces[g] for g in grams(word, n) if g in self.pieces]:
                return self.rows[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " ")
        parts = pc.split_pattern(letters, " ")
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        n = len(texts)
        if not self.languages or not names:
            return [UNKNOWN] * n, np.zeros(n)
        own = np.array([self.word(w) if w else np.zeros(len(self.languages), np.float32) for w in names], np.float64)
        full = np.array([bool(w) for w in names])[codes]
        sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(own[codes, j])])[starts]) for j in range(len(self.languages))], axis=1)
        some = np.diff(np.concatenate([[0], np.cumsum(full)])[starts]) > 0
        shares = np.exp(sums - sums.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, shares[np.arange(n), best], 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, sample_chars: int = 1_500_000) -> Model:
    """Fit on labelled rows outside one fold of ids; the sample has about sample_chars characters a language.

    Rows enter by a hash of the id and text below a share that follows from each language's length, so the sample
    depends on the rows and not on their order; counting lengths reads all labelled rows. Every language is learned.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("key"), folds) != fold))
    drawn = sample(rows, sample_chars)
    words = drawn.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    model = Model.fit(list(zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n")))))
    del counts
    give_back()
    return model


def sample(rows: DataFrame, sample_chars: int) -> DataFrame:
    """lang and text of about sample_chars characters a language, from rows with key, text and lang.

    Texts are drawn in stretches of a fifteenth of that at most, so that a few very long ones neither fill the sample
    nor miss it; a word belongs to the stretch that it begins in. The stretch first by hash is always drawn.
    """
    size = max(1000, sample_chars // 15)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0)).cast("int"))))
    start = F.col("part") * size
    piece = F.substring("text", start + 1, F.lit(size))
    rest = F.regexp_extract(F.substring("text", start + size, F.lit(1000)), r"^\p{L}(\p{L}+)", 1)
    begun = F.substring("text", start, F.lit(1)).rlike(r"^\p{L}")
    whole = F.length("text") <= size
    cut = F.concat(F.when(begun & (F.col("part") > 0), F.regexp_replace(piece, r"^\p{L}+", "")).otherwise(piece), rest)
    place = F.when(F.col("part") == 0, F.xxhash64("key", "text")).otherwise(F.xxhash64("key", "text", "part"))
    parts = parts.select("lang", F.when(whole, F.col("text")).otherwise(cut).alias("text"), F.when(whole, F.length("text")).otherwise(F.length(piece)).alias("length"), (F.pmod(place, F.lit(1 << 30)) / float(1 << 30)).alias("place"))
    first = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("place")))
    shares = parts.groupBy("lang").agg(F.least(F.lit(1.0), sample_chars / F.greatest(F.sum("length"), F.lit(1))).alias("share"), first.alias("first"))
    shares = Scratch(rows.sparkSession, "langid").save(shares, "shares", release=False)
    return parts.join(shares, "lang").filter((F.col("place") < F.col("share")) | (F.col("place") == F.col("first"))).select("lang", "text")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the columns named in keep, which must not be lang_pred or score (ValueError)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = named_apart(tuple(c for c in keep if c not in ("doc_id", "text")), ("lang_pred", "score"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in carried.items()])
    drop = [] if "text" in keep else ["text"]
    kept = [f for f in rows.schema.fields if f.name not in drop]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            lang, score = own.predict(batch.column("text"))
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema).withColumnsRenamed({k: c for c, k in carried.items()})
