import random
from collections import Counter, defaultdict

from conftest import prose

import numpy as np
import pyarrow as pa

from lodestrand.llm import minhash
from lodestrand.llm.common import Scratch
from lodestrand.llm.components import components


def brute(rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        members[root(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in members[root(i)] if k is not None]
        low = min(known) if known and sets[i] else key
        out.append((key, len(sets[i]), low, key == low))
    return Counter(out)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows)


def test_odd_rows(odd):
    check(odd)


def test_no_rows(none):
    assert minhash.near_duplicates(none).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Copies with more and more words changed: some are linked with the first, some with each other, some with none."""
    own, base = random.Random(5), prose(9, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(own.randrange(0, 9)):
            words[own.randrange(len(words))] = f"x{own.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(100 + i, 150)) for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_signatures_agree_as_sets_do():
    a = minhash.shingle_sets(pa.array([prose(1, 2000)]))[0]
    rng = np.random.default_rng(0)
    b = np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 2**63, len(a) // 4, dtype=np.uint64)])
    likeness = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - likeness) < 0.1
    assert (minhash.signature(a) == minhash.signature(a[::-1])).all()


def test_both_permutations_are_permutations():
    places = minhash.scatter(np.arange(minhash.CIRCLE, dtype=np.uint64))
    assert len(np.unique(places)) == minhash.CIRCLE
    assert len(np.unique(minhash.permutation()[: minhash.CIRCLE])) == minhash.CIRCLE


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 50), (100, 60), (61, 60), (7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), "c").collect()}
    assert found == {i: 0 for i in range(31)} | {50: 50, 60: 50, 61: 50, 100: 50}


def test_one_row_of_a_component_stays(spark):
    """By id and text: other texts under the same id are documents of their own, and null ids come last."""
    a, b = prose(21, 80), prose(22, 80)
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (None, b), (None, prose(23, 80)), (None, prose(23, 80)), (3, ""), (4, None)], "doc_id long, text string")
    found = minhash.near_duplicates(docs).join(docs.selectExpr("text", "xxhash64(text) as text_hash").distinct(), "text_hash", "left")
    stay = Counter((r["doc_id"], r["text"]) for r in found.filter("stays").collect())
    assert stay == Counter([(1, a), (1, b), (None, prose(23, 80)), (None, prose(23, 80)), (3, ""), (4, None)])


def test_texts_above_a_group_s_bound(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    test_a_large_group_of_near_copies(spark)


def test_links_at_the_threshold(spark):
    """Pairs with a likeness of 0.75 to 0.80 only: none may be lost."""
    own, rows = random.Random(31), []
    for i in range(300):
        words = [f"u{i}x{j}" for j in range(200)]
        other = list(words)
        for at in own.sample(range(5, 195), 6):
            other[at] = f"v{i}y{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
