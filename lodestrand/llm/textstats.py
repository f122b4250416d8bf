"""Counts over slices of texts, with numpy; used by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORD_SPACE, Words, bytes_in, raw  # noqa: F401 - the latter are used as this module's


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of set flags of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[starts])


def code_points(data: np.ndarray) -> np.ndarray:
    """Where a code point begins."""
    return (data & 0xC0) != 0x80


def owner(starts: np.ndarray) -> np.ndarray:
    """The text of each position."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def distinct(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of distinct codes of each text."""
    keys = np.unique(owner(starts) << 32 | codes.astype(np.int64))
    return np.bincount(keys >> 32, minlength=len(starts) - 1)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines that hold a word, and those equal to an earlier line."""
    parts = pc.split_pattern(texts, "\n")
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    full = worded[codes] if len(codes) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(full)])[starts]
    n = np.diff(starts)
    return n, n - distinct(codes[full], starts)


def repeated_words(words: Words, k: int = 3) -> np.ndarray:
    """For each text, the words that stand in some run of k words found twice or more in it."""
    codes, starts = words.codes.astype(np.int64), words.starts
    n = len(codes)
    if n < k:
        return np.zeros(len(starts) - 1, np.int64)
    of = owner(starts)
    inside = of[: n - k + 1] == of[k - 1 :]
    bits = max(1, int(len(words.names)).bit_length())
    if k * bits + int(len(starts)).bit_length() <= 63:
        keys = of[: n - k + 1]
        for j in range(k):
            keys = keys << bits | codes[j : n - k + 1 + j]
    else:  # too many words for one number: number the runs step by step
        keys = of[: n - k + 1]
        for j in range(k):
            keys = np.unique(keys * (len(words.names) + 1) + codes[j : n - k + 1 + j], return_inverse=True)[1]
    keys = np.where(inside, keys, -1)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = (count[back] >= 2) & inside
    covered = np.zeros(n, bool)
    for j in range(k):
        covered[j : n - k + 1 + j] |= again
    return per_text(covered, starts)
