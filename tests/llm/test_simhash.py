import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from lodestrand.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    said = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, radius=4):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = roots(fps)
    out = []
    for (key, _), f in zip(rows, fps):
        known = [k for (k, _), g in zip(rows, fps) if root[g] == root[f] and k is not None]
        out.append((key, f"{f:016x}", min(known) if known else None))
    return Counter(out)


def check(docs, **how):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs, **how).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute(rows)


def test_odd_rows(odd):
    check(odd)


def test_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0


def test_rows_without_ids_and_words(spark):
    check(spark.createDataFrame([(None, "a b c d e"), (None, ""), (7, None), (3, " \n"), (None, "once more with feeling now")], "doc_id long, text string"))


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_copies_with_changed_words(spark, segments):
    own, rows = random.Random(5), []
    for base in range(8):
        words = prose(base, 150).split()
        for i in range(12):
            said = list(words)
            for _ in range(own.randrange(0, 6)):
                said[own.randrange(len(said))] = f"x{own.randrange(10**6)}"
            rows.append((100 * base + i, " ".join(said)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), segments=segments)


def linked(spark, fps, segments, monkeypatch):
    """Components of given fingerprints, with the documents' numbers as their texts."""
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    docs = spark.createDataFrame([(i, str(f)) for i, f in enumerate(signed)], "doc_id long, text string")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, segments=segments).collect()}
    root = roots(fps)
    least = {r: min(i for i, f in enumerate(fps) if root[f] == r) for r in root.values()}
    assert found == {i: (f"{f:016x}", least[root[f]]) for i, f in enumerate(fps)}


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_every_way_to_differ_in_four_bits(spark, segments, monkeypatch):
    """Pairs with one to five different bits anywhere, in the first and last segments' corners too; no pair is lost."""
    own, fps = random.Random(segments), []
    for k in range(240):
        f = own.getrandbits(64)
        bits = own.sample([0, 1, 15, 16, 20, 21, 22, 31, 32, 41, 42, 43, 47, 48, 62, 63] if k % 2 else range(64), k % 5 + 1)
        fps += [f, f ^ sum(1 << b for b in bits)]
    linked(spark, fps, segments, monkeypatch)


def test_a_large_cluster(spark, monkeypatch):
    """Fingerprints around one, most of them not linked with a leader, packed in lists of a few."""
    monkeypatch.setattr(simhash, "LIST", 16)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    own, base = random.Random(9), random.Random(8).getrandbits(64)
    fps = list(dict.fromkeys(base ^ sum(1 << b for b in own.sample(range(64), own.randrange(1, 7))) for _ in range(400)))
    linked(spark, fps, 3, monkeypatch)


def test_hash_is_sparks_own(spark):
    """The shingles' hash is that of xxhash64 in SQL, which has the same seed."""
    said = ["a b c d", "naïve résumé 🙂 x", prose(1, 4)]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select(F.xxhash64("s")).collect()
    assert [r[0] & (1 << 64) - 1 for r in rows] == [xxhash.xxh64_intdigest(s.encode(), simhash.SEED) for s in said]


def test_balls_cover_the_radius():
    """For any spread of four differing bits over the segments some segment's ball holds them."""
    for segments in (2, 3, 4):
        widths = [64 * (i + 1) // segments - 64 * i // segments for i in range(segments)]
        plan = {first: radius for first, _, radius in simhash.plan(segments)}
        starts = [64 * i // segments for i in range(segments)]
        spreads = [()]
        for w in widths:
            spreads = [s + (k,) for s in spreads for k in range(5) if sum(s) + k <= 4]
        assert all(any(starts[i] in plan and k <= plan[starts[i]] for i, k in enumerate(s)) for s in spreads)


def test_number_of_segments_follows_the_size():
    assert [simhash.segments_for(n) for n in (10, 10**6, 10**10)] == [4, 3, 2]
