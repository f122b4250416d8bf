"""Quality classifier: sparse rule ensemble.

Statistics of each text are columns. Small boosted trees over a sample of labelled rows propose rules: every path from
a root is a conjunction of comparisons of statistics. A logistic model over the rules with an L1 penalty keeps few of
them, and the kept rules with their weights become one Spark column expression that scores every row.

The sample is bounded by sample_rows and drawn by a hash of the id; statistics and scores cover whole texts of all
rows. Null text counts as empty; empty texts have statistics of 0 and are scored like any other. Rows without a label
do not train; without any usable label, or with one class only, the score is that share (0.5 without labels).
Repeated rows and ties are scored alike; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import Scratch, Words, slices
from .langid import remainder

STATISTICS = (
    "n_words n_chars mean_word long_words short_words distinct_words repeated_words n_lines words_a_line dup_lines "
    "symbols capitals digits stops bangs bars other_ascii white"
).split()


def measure(texts: pa.Array) -> np.ndarray:
    """The statistics of a slice of texts, a row for each; shares are of words, lines or code points."""
    texts = pc.fill_null(texts, "")
    data, starts = ts.raw(texts)
    words = Words(texts)
    n_words = np.diff(words.starts)
    n_chars = ts.per_text(ts.code_points(data), starts)
    space = ts.bytes_in(data, ts.WORD_SPACE)
    lengths = pc.utf8_length(words.names).to_numpy(zero_copy_only=False)[words.codes] if len(words.names) else np.zeros(0, np.int64)
    n_lines, dup = ts.lines(texts)
    of_words, of_chars, of_lines = np.maximum(n_words, 1), np.maximum(n_chars, 1), np.maximum(n_lines, 1)

    def share(chars: str | list[int]) -> np.ndarray:
        return ts.per_text(ts.bytes_in(data, chars), starts) / of_chars

    # Capital letters of ASCII, and of Latin-1 in their second byte.
    capital = (data >= 0x41) & (data <= 0x5A)
    if len(data):
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    columns = [
        n_words,
        n_chars,
        (n_chars - ts.per_text(space, starts)) / of_words,
        ts.per_text(lengths >= 12, words.starts) / of_words,
        ts.per_text(lengths <= 3, words.starts) / of_words,
        ts.distinct(words.codes, words.starts) / of_words,
        ts.repeated_words(words) / of_words,
        n_lines,
        n_words / of_lines,
        dup / of_lines,
        share("#*$%&<>"),
        ts.per_text(capital, starts) / of_chars,
        share("0123456789"),
        share(".,;:"),
        share("!?"),
        share("|"),
        share("()[]{}@=+_~^/\\\"'`-"),
        ts.per_text(space, starts) / of_chars,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            matrix = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in matrix.T)], ["doc_id", *STATISTICS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A comparison: the statistic's place, whether it must be above the threshold, and the threshold. A rule is a tuple of them.
Comparison = tuple[int, bool, float]
Rule = tuple[Comparison, ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for at, above, cut in rule:
        found &= (x[:, at] > cut) == above
    return found


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, least: int) -> list[tuple[Rule, float]]:
    """A regression tree by Newton gain over given cuts: all its paths, and for leaves the step (0 for inner nodes)."""
    found: list[tuple[Rule, float]] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        g, h = gradient[rows], weight[rows]
        best, own = 1e-6, None
        if len(path) < depth and len(rows) >= 2 * least:
            total = g.sum() ** 2 / (h.sum() + 1)
            for at, places in enumerate(cuts):
                if not len(places):
                    continue
                bins = np.searchsorted(places, x[rows, at], side="left")
                n = np.cumsum(np.bincount(bins, minlength=len(places) + 1))[:-1]
                gs = np.cumsum(np.bincount(bins, g, len(places) + 1))
                hs = np.cumsum(np.bincount(bins, h, len(places) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - total
                gain[(n < least) | (len(rows) - n < least)] = 0
                if gain.max() > best:
                    best, own = gain.max(), (at, float(places[gain.argmax()]))
        if path:
            found.append((path, 0.0 if own else float(g.sum() / (h.sum() + 1))))
        if own:
            above = x[rows, own[0]] > own[1]
            split(rows[~above], (*path, (own[0], False, own[1])))
            split(rows[above], (*path, (own[0], True, own[1])))

    split(np.arange(len(x)), ())
    return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty on the weights, by accelerated proximal steps."""
    n, m = r.shape
    full = np.concatenate([np.ones((n, 1)), r], axis=1)
    probe = np.ones(m + 1)
    for _ in range(30):
        probe = full.T @ (full @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / float(probe @ (full.T @ (full @ probe)))
    w = ahead = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        moved = ahead - step * (full.T @ (sigmoid(full @ ahead) - y)) / n
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = moved + (t - 1) / after * (moved - w)
        w, t = moved, after
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    """Weighted rules over statistics; the score is the logistic of their sum."""

    intercept: float
    rules: list[tuple[Rule, float]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.001, bins: int = 64) -> RuleModel:
        share = float(y.mean()) if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            return cls(30.0 * (2 * share - 1), [])
        least = max(5, len(y) // 500)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        z = np.full(len(y), np.log(share / (1 - share)))
        paths: dict[Rule, np.ndarray] = {}
        for _ in range(trees):
            p = sigmoid(z)
            for rule, step in grow(x, cuts, y - p, p * (1 - p), depth, least):
                own = paths.setdefault(rule, holds(rule, x))
                z += rate * step * own
        # Rules that hold for the same rows count once; the shortest stands for them.
        kept: dict[bytes, Rule] = {}
        for rule in sorted(paths, key=len):
            own = paths[rule]
            if least <= own.sum() <= len(y) - least:
                kept.setdefault(np.packbits(own).tobytes(), rule)
        rules = list(kept.values())
        matrix = np.stack([paths[r] for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
        intercept, weights = lasso(matrix, y, penalty)
        return cls(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as a Spark expression over the columns of the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for at, above, cut in rule:
                own = F.col(STATISTICS[at]) > F.lit(cut)
                met = met & (own if above else ~own)
            z = z + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, fold: int = 0, sample_rows: int = 20_000) -> RuleModel:
    """Fit on labelled rows outside one fold of ids, on about sample_rows of the different ones."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    usable = usable.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != fold))
    # Repeated rows count once; the rows that are left are counted, so that the sample has its bound whatever repeats.
    labelled = Scratch(measured.sparkSession, "labelled").save(measured.join(usable, "doc_id").distinct(), "rows", release=False)
    place = F.pmod(F.xxhash64("doc_id", *STATISTICS), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.filter(place < min(1.0, sample_rows / max(labelled.count(), 1))).toArrow()
    if not rows.num_rows:
        return RuleModel.fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "label", *STATISTICS)])
    return RuleModel.fit(np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1), (rows.column("label").to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3, **fitting) -> DataFrame:
    """doc_id, score and predicted (1 if the score is at least `least`) of every row, and its statistics."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(statistics(docs), "statistics")
    model = fit(measured, labels, **fitting)
    scored = measured.withColumn("score", model.column())
    return scored.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
