import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def chunked():
    return packing.ChunkTokenizer(PATH, most=50)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab A.,'s\n\t1 é　🙂|<>")) | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_ids_are_the_tokenizers(tokenizer, chunked, texts):
    import pyarrow as pa

    texts = [*texts, "it's  two", " lead", "tail ", "x\n y", "<|endoftext|> z", "a <|endoftext|>", "b<|endoftext|><|endoftext|> c  d", "<|endoftext", "", SPECIAL.join(texts)]
    ids, at = chunked.texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check(docs, tokenizer, size=64, open_sequences=8, **how):
    rows = packing.pack(docs, PATH, size=size, open_sequences=open_sequences, **how).collect()
    want = []
    for key, text in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = packing.cut(len(ids), size)
        assert all(n == size for _, n in cuts[1:]) and sum(n for _, n in cuts) == len(ids)
        want += [(key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    return len(places), sum(r["length"] for r in rows)


def test_odd_rows(odd, tokenizer):
    check(odd, tokenizer)
    check(odd, tokenizer, sort_batches=False)


def test_special_tokens_in_texts(spark, tokenizer):
    docs = spark.createDataFrame([(1, f"one {SPECIAL} two"), (2, SPECIAL), (3, f"{SPECIAL}{SPECIAL} {SPECIAL}x" * 40)], "doc_id long, text string")
    check(docs, tokenizer)


def test_no_rows(none):
    assert packing.pack(none, PATH).count() == 0


def test_few_sequences(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 60)) for i in range(600)], "doc_id long, text string").coalesce(1)
    n, tokens = check(docs, tokenizer, open_sequences=512)
    assert n <= 1.03 * tokens / 64 + 1


def test_best_fit_and_the_fullest_closes():
    bins = packing.BestFit(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # fits both, the tighter one takes it and is full
    assert bins.put(5) == (2, 0)
    assert bins.put(9) == (3, 0)  # sequence 0, with 4 free, is the fullest and closes
    assert bins.put(4) == (2, 5)
