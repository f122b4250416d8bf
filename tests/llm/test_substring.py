import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from lodestrand.llm import substring


def brute(texts, length):
    lists = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 10])
def test_equals_brute_force(spark, odd, length):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows], length)))
    got = Counter(tuple(r) for r in substring.digests(substring.repeated(odd, length)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want


def test_no_rows(none):
    assert substring.repeated(none).count() == 0


def test_untouched_texts_keep_their_white_space(spark):
    docs = spark.createDataFrame([(1, "a  b\n c")], "doc_id long, text string")
    row = substring.repeated(docs).first()
    assert row["text"] == "a  b\n c" and row["kept"] == "a b c"


def shards_removed(shards, length, bits=64):
    """The steps of repeated() on lists of texts, one for each shard: for each shard the words removed of each text."""
    made = []
    for texts in shards:
        windows = substring.Windows(pa.array(texts, pa.string()), length, bits=bits)
        listed = substring.passages(windows, np.ones(len(windows.at), bool))
        made.append((windows, listed.to_pylist()))
    counts, places = Counter(), {}
    for at, (_, listed) in enumerate(made):
        for k, p in enumerate(listed):
            for i, (h, many) in enumerate(zip(p["hashes"], p["many"])):
                counts[h] += 1 + many
                places.setdefault(h, []).append((at, k, i))
    out = []
    for shard, (windows, listed) in enumerate(made):
        masks = Counter()
        for p in listed:
            for h in p["hashes"]:
                if counts[h] > 1:
                    at, k, i = places[h][-1 if places[h][0][0] == shard else 0]
                    masks[at, k] |= 1 << i
        said = pa.array([made[at][1][k]["said"] for at, k in masks], pa.string())
        own = np.array([at == shard for at, _ in masks], np.int64)
        removed = substring.locate(windows, said, np.array([m - (1 << 64) if m >> 63 else m for m in masks.values()], np.int64), own)
        starts = windows.words.starts
        kept = substring.kept_words(windows.words, removed).to_pylist()
        out.append([(int(b - a), int(removed[a:b].sum()), hashlib.sha256(k.encode()).hexdigest()) for a, b, k in zip(starts[:-1], starts[1:], kept)])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=4), min_size=1, max_size=3), st.integers(5, 12))
def test_automata_find_passages_of_other_shards(shards, length):
    shards = [[" ".join(x) for x in texts] for texts in shards]
    got = shards_removed(shards, length)
    assert [g for shard in got for g in shard] == brute([t for texts in shards for t in texts], length)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcde"), max_size=40), min_size=1, max_size=4), min_size=2, max_size=3), st.integers(5, 9), st.integers(1, 6))
def test_a_hash_of_few_bits_removes_nothing_unique(shards, length, bits):
    """Words decide: where most windows share their hash with others, no word of only unique windows goes."""
    shards = [[" ".join(x) for x in texts] for texts in shards]
    want = brute([t for texts in shards for t in texts], length)
    got = [g for shard in shards_removed(shards, length, bits) for g in shard]
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_a_16_bit_hash_removes_nothing_unique(spark):
    from conftest import prose

    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([(i, prose(i, 4000, words)) for i in range(40)], "doc_id long, text string")
    rows = substring.repeated(docs, 10, bits=16).collect()
    assert sum(r["n_removed"] for r in rows) == 0 and sum(r["n_words"] for r in rows) == 160_000


def test_passages_longer_than_one_mask(spark):
    from conftest import prose

    long = prose(3, 700)
    docs = spark.createDataFrame([(1, "a b " + long + " c"), (2, "d " + long), (3, prose(4, 50) + " " + " ".join(long.split()[100:400]))], "doc_id long, text string")
    got = Counter(tuple(r) for r in substring.digests(substring.repeated(docs, 35)).collect())
    assert got == Counter((i + 1, *b) for i, b in enumerate(brute([r["text"] for r in docs.collect()], 35)))


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2, "h")], "doc_id long, text string, shard string, place int, hash string")
    assert substring.repeated(docs, keep=("shard", "place", "hash")).first()["shard"] == "x"
    with pytest.raises(ValueError):
        substring.repeated(docs.withColumn("kept", docs["text"]), keep=("kept",))


def test_no_table_stays_in_the_catalog(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    substring.repeated(odd).count()
    assert {t.name for t in spark.catalog.listTables()} == before


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=12, max_size=60))
def test_equal_windows_have_equal_anchors(words):
    windows = substring.Windows(pa.array([" ".join(words)]), 12)
    least, place = windows.anchors()
    by_window = {}
    for i, (a, p) in enumerate(zip(least, place)):
        assert i <= p <= i + 12 - substring.ANCHOR
        assert by_window.setdefault(tuple(words[i : i + 12]), (a, p - i)) == (a, p - i)
