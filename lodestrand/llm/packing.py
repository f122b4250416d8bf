"""Best-fit packing: bounded-space online best fit over tokenised documents.

Each task packs the documents it reads. It holds a fixed number of open sequences, listed by their free space; a
bitset has a bit for each free space that some open sequence has, so the tightest sequence that a piece fits is the
lowest set bit at or above its length. When a new sequence is needed and the number is reached, the fullest closes.
No row moves between tasks, so packing needs no shuffle; what a task leaves half full is at most its open sequences.

A null text is empty (it is then the end id alone). Repeated rows and ties are packed like any other rows; a null id
stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: Bytes of text tokenised at once: more of them repeat more chunks.
SLICE = 8 << 20

#: Fixed value: the pattern that byte-level BPE splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space that the tokenizer's pattern may join with a space.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"


def byte_level(path: str):
    """The merges and vocabulary of a tokenizers file as an encoder of tiktoken, and its special tokens' strings.

    Both engines give the same ids where ids follow the order of merges, which is checked here; tiktoken's takes a
    fifth of the time for words that it has not met. A special token's string in a text has the token's id, as the
    tokenizers library gives it.
    """
    import json
    from pathlib import Path

    import tiktoken

    made = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    if any(t[flag] for t in made["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that are not plain strings")
    vocabulary = {t: i for t, i in made["model"]["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in made["model"]["merges"]]
    if made["pre_tokenizer"]["type"] != "ByteLevel" or made.get("normalizer") or merged != sorted(merged):
        raise ValueError(f"{path} is not a plain byte-level BPE with ids in the order of merges")
    # Byte-level files write printable bytes as themselves and the others as code points from 256 up, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), list(special)


def joined(names: pa.Array) -> list[str]:
    """Strings without spaces, as a list; through one string, which is faster than one by one."""
    rows = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
    return pc.binary_join(rows, " ")[0].as_py().split(" ") if len(names) else []


class ChunkTokenizer:
    """Token ids of many texts, as the tokenizer gives them, from the ids of their space-separated chunks.

    Byte-level BPE never joins across its pattern's matches, and a match begins at each single space that stands
    between two other characters. So such texts have the ids of " chunk" after " chunk", and each distinct chunk is
    encoded once. Texts with a space beside other white space, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.bpe, self.special = byte_level(path)
        # A token that begins with a space begins a chunk.
        self.begins = np.zeros(self.bpe.n_vocab, bool)
        self.begins[[self.bpe.encode_single_token(t) for t in self.bpe.token_byte_values() if t[:1] == b" "]] = True
        self.most = most
        self.known = {"": 0}
        space = self.encode(" ")
        self.ids, self.ends = space, np.array([0, len(space)], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)

    def spaced(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " name" after " name", and where each begins: one call, cut at tokens that begin with a space."""
        if not names:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        ids = self.encode(" " + " ".join(names))
        starts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        assert len(starts) == len(names) + 1, "a chunk without its own first token"
        return ids, starts

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, f"{SPACES} | {SPACES}")
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(whole)
        plain = pc.split_pattern(pc.if_else(pa.array(whole), "", texts) if len(rows) else texts, " ")
        counts = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(counts)])
        coded = plain.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The first chunk of a text has no space before it, so it is a string of its own, as is a whole text.
        heads = coded.dictionary.take(pa.array(codes[begins[:-1]])).to_pylist()
        alone = [self.encode(texts[i].as_py() if whole[i] else head) for i, head in enumerate(heads)]
        names = joined(coded.dictionary)
        find = self.known.get
        at = np.fromiter((find(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        fresh, starts = self.spaced([names[i] for i in new])
        # One table for this call: what is known, then the new chunks, then the heads.
        ids = np.concatenate([self.ids, fresh, *alone])
        base = len(self.ids)
        lengths = np.fromiter(map(len, alone), np.int64, len(alone))
        ends = np.concatenate([self.ends[:-1], base + starts[:-1], base + len(fresh) + np.concatenate([[0], np.cumsum(lengths)])])
        at[new] = len(self.ends) - 1 + np.arange(len(new))
        places = at[codes]
        places[begins[:-1]] = len(self.ends) - 1 + len(new) + np.arange(len(alone))
        if (room := min(self.most - len(self.known), len(new))) > 0:
            self.known |= {names[i]: len(self.ends) - 1 + k for k, i in enumerate(new[:room])}
            self.ids = ids[: base + starts[room]]
            self.ends = np.concatenate([self.ends, base + starts[1 : room + 1]])
        n = np.diff(ends)[places]
        stops = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(ends[places] - stops[:-1], n) + np.arange(stops[-1])
        return ids[take], stops[begins]


class BestFit:
    """Open sequences in a bitset keyed by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, n: int) -> tuple[int, int]:
        """Place a piece of n tokens; the sequence's number and the offset in it."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, own = self.size, self.next
            self.next += 1
        if left := free - n:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(own)
            self.open += 1
        return own, self.size - free

    def _take(self, free: int) -> int:
        own = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return own


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens: all but the first have the full size."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n > size else [(0, n)]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, open_sequences: int = 4096, sort_batches: bool = True) -> DataFrame:
    """Pack documents into sequences of at most size tokens; one row for each piece.

    tokenizer is the path of a byte-level BPE file of the tokenizers library, there on every executor. With
    sort_batches the longer pieces of an Arrow batch are placed first, a look-ahead of bounded size; without it pieces
    are placed in the order in which the task reads them. sequence_id is unique over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = ChunkTokenizer(tokenizer), BestFit(size, open_sequences)
        high = TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=SLICE):
            ids, at = encoder.texts(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            pieces = []
            end = np.array([end_id], np.uint32)
            for row, key in enumerate(keys):
                own = np.concatenate([ids[at[row] : at[row + 1]], end])
                pieces += [(key, k, s, n, zlib.crc32(own[s : s + n].astype("<u4", copy=False))) for k, (s, n) in enumerate(cut(len(own), size))]
            if sort_batches:
                pieces.sort(key=lambda p: -p[3])
            placed = [bins.put(p[3]) for p in pieces]
            columns = [*zip(*pieces)] + [[high + s for s, _ in placed], [o for _, o in placed]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
