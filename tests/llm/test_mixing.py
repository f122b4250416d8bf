import hashlib

import pytest

from lodestrand.llm import mixing


def test_targets_share_the_excess_by_weight(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 10), ("c", 50), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    # weights 1, 2, 3, 1 of 200: b stops at 30, the rest is shared 1 : 3 : 1
    assert got == pytest.approx({"a": 34.0, "b": 30.0, "c": 102.0, None: 34.0})


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    open_, target, total = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    return sizes, target


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    sizes, target = brute(rows)
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
    again = sorted(mixing.mix(odd).collect(), key=str)
    assert again == sorted(got, key=str)


def test_the_threshold_is_that_of_a_sort(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 5 == 0]) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for source in "ab":
        rows = sorted((int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r) for r in got if r["source"] == source)
        size, goal = rows[0][1]["source_size"], rows[0][1]["target"]
        rounds = int(goal // size)
        extra = [r["taken"] - rounds * r["size"] for _, r in rows]
        assert all(x in (0, r["size"]) for x, (_, r) in zip(extra, rows))
        assert sorted(extra, key=lambda x: x == 0) == extra  # those below the threshold come first
        assert abs(sum(r["taken"] for _, r in rows) - goal) <= 4


def test_no_rows(none):
    assert mixing.mix(none).count() == 0


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "h")], "doc_id long, text string, source string, place int, source_key string")
    row = mixing.mix(docs, keep=("place", "source_key", "text")).first()
    assert (row["place"], row["source_key"], row["text"], row["taken"]) == (7, "h", "a b", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("target", docs["place"]), keep=("target",))
