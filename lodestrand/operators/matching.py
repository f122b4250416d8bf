"""Fuzzy names: a similarity of sorted tokens by longest common subsequence, best matches above a threshold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

THRESHOLD = 0.6
#: Names that stand for nobody.
PLACEHOLDERS = ("host", "speaker", "unknown speaker", "speaker 1", "speaker 2", "speaker 3", "speaker 4", "speaker 5")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word at a time: a bit of a number for each place of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sorted_tokens(text: str | None) -> str:
    return " ".join(sorted(re.findall(r"\w+", (text or "").lower())))


def ratio(a: str | None, b: str | None) -> float:
    """100 for equal token lists in any order, 0 for nothing in common or two empty names."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return 200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 0.0


def set_ratio(a: str | None, b: str | None) -> float:
    """100 if all tokens of one are among the other's; else the best ratio of common tokens and both token sets."""
    x, y = (set(re.findall(r"\w+", (t or "").lower())) for t in (a, b))
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    own, other = (" ".join(filter(None, (common, " ".join(sorted(s))))) for s in (x - y, y - x))
    if common and common in (own, other):
        return 100.0
    pairs = [(own, other), *([(common, own), (common, other)] if common else [])]
    return max(200.0 * common_subsequence(p, q) / (len(p) + len(q)) for p, q in pairs)


def similarity(a: Column, b: Column) -> Column:
    """ratio as a column."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(left, right)], dtype="float64")

    return run(a, b)


#: Names and candidates in a block; each block of one meets each block of the other in a row.
NAME_BLOCK, CANDIDATE_BLOCK = 1000, 4000


def _blocks(rows: DataFrame, column: str, size: int) -> tuple[DataFrame, int]:
    """block and values: distinct values dealt by hash to lists of about so many, and the number of lists."""
    values = cut(rows.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct())
    n = max(1, -(-values.count() // size))
    return values.groupBy(F.pmod(F.xxhash64("value"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list("value").alias("values")), n


class _Candidates:
    """A block of candidates with the counts of their letters."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.tokens = [sorted_tokens(c) for c in self.names]
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(self.tokens))))}
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        self.counts = np.zeros((len(self.names), len(self.letters)), np.int16)
        for row, t in zip(self.counts, self.tokens):
            for c, n in Counter(t).items():
                row[self.letters[c]] = n

    def best(self, name: str, k: int, least: float) -> list[tuple[float, str]]:
        """Negated score and candidate of the k best that reach the least score."""
        mine = sorted_tokens(name)
        own = np.zeros(len(self.letters), np.int16)
        for c, n in Counter(mine).items():
            if c in self.letters:
                own[self.letters[c]] = n
        # The common subsequence has no more of a letter than either side.
        most = np.round(200.0 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(self.lengths + len(mine), 1), 6)
        found: list[tuple[float, str]] = []
        some = np.flatnonzero(most >= least)
        for at in some[np.argsort(-most[some], kind="stable")]:
            if len(found) == k and most[at] < -found[-1][0]:
                break
            x = self.tokens[at]
            score = round(200.0 * common_subsequence(mine, x) / (len(mine) + len(x)), 6) if mine or x else 0.0
            if score >= least:
                found = sorted([*found, (-score, self.names[at])])[:k]
        return found


def matches(names: DataFrame, candidates: DataFrame, k: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """name, candidate, score, rank: the k best candidates of each name whose score reaches the threshold.

    names are a batch of inputs, candidates the distinct participants; nulls are neither. Both are packed into blocks,
    and each block of names meets each block of candidates in a task, which bounds scores by the letters that both have,
    computes those that can reach the threshold and the k-th best, and passes on k rows for a name. So pairs never become
    rows, and neither side goes through the driver.
    """
    least = 100 * threshold
    asked, _ = _blocks(names, "name", NAME_BLOCK)
    known, n = _blocks(candidates, "candidate", CANDIDATE_BLOCK)
    sides = asked.select(F.col("values").alias("names"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(known, "block").select("names", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(batch.column("names").to_pylist(), batch.column("values").to_pylist()):
                block = _Candidates(theirs)
                rows = [(name, c, -s) for name in mine for s, c in block.best(name, k, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64()))], ["name", "candidate", "score"])

    found = sides.repartition(asked.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "name string, candidate string, score double")
    order = Window.partitionBy("name").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_match(names: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """name, candidate and score of the best candidate at or above the threshold; null candidate if none."""
    found = matches(names, candidates, 1, threshold).drop("rank")
    return names.select("name").distinct().join(found, "name", "left")


def named_in(text: Column, participants: Column) -> Column:
    """Participants with a part of four or more characters among the tokens of the text; placeholders are skipped."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    real = F.filter(participants, lambda p: ~F.lower(p).isin(*PLACEHOLDERS))
    return F.filter(real, lambda p: F.exists(F.split(F.lower(p), r"\s+"), lambda x: (F.length(x) >= 4) & F.array_contains(words, x)))


#: A part of a name is found in a text from this set ratio on, parts from this length.
DETECT, PART = 80, 4


def detect_and_resolve(texts: DataFrame, participants: list[str], recognise: Callable[[str], list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add detected and resolved: names in the text, and the participants that they stand for, each once, in order.

    recognise finds names in a text (a model); besides, a participant is detected if a part of the name has a set ratio
    of DETECT or more with the text. Each name is then resolved to the best participant, as best_match does.
    """
    real = [p for p in participants if p.lower() not in PLACEHOLDERS]

    def detect(text: str) -> list[str]:
        words = set(re.findall(r"\w+", text.lower()))
        size = len(" ".join(sorted(words)))
        found = list(recognise(text)) if recognise else []
        for person in real:
            parts = [x for x in person.lower().split() if len(x) >= PART]
            # A part that is no word of the text reaches the ratio only if the text is not much longer.
            if any(set(re.findall(r"\w+", x)) <= words or size <= 1.5 * len(x) and set_ratio(x, text) >= DETECT for x in parts):
                found.append(person)
        return list(dict.fromkeys(found))

    def resolve(name: str) -> str | None:
        best = min(((-round(ratio(name, p), 6), p) for p in participants), default=(0.0, ""))
        return best[1] if -best[0] >= 100 * threshold else None

    @F.pandas_udf("struct<detected:array<string>,resolved:array<string>>")
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for text in series:
            found = detect(text or "")
            rows.append((found, [*dict.fromkeys(x for x in map(resolve, found) if x)]))
        return pd.DataFrame(rows, columns=["detected", "resolved"])

    made = run(F.col("text"))
    return texts.withColumn("_found", made).select("*", "_found.detected", "_found.resolved").drop("_found")


def resolve_pronoun(participants: Column) -> Column:
    """Whom a pronoun of the third person stands for: the participant, if there is only one, else null."""
    return F.when(F.size(participants) == 1, F.element_at(participants, 1))


def find_person(catalog: DataFrame, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """candidate, score and rank of the three best participants of a catalog for a name as typed."""
    typed = catalog.sparkSession.createDataFrame([(name,)], "name string")
    return matches(typed, catalog.select(F.explode("participants").alias("candidate")), 3, threshold).drop("name")
