import random
from collections import Counter

import pytest

from lodestrand.llm import pointintime

VERSION = "key string, event long, arrival long, expiry long, id long, note string, start long, cell long, part int, time long"
ASK = "key string, time long, name string, event2 long"


def versions_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], VERSION).drop("start", "cell", "part", "time")


def down(v):
    return (v is not None, v if v is not None else "")


def brute(versions, asks):
    out = []
    for key, time, *more in asks:
        fit = [v for v in versions if None not in (key, time, v[0], v[1], v[2]) and v[0] == key and v[1] <= time and v[2] <= time and (v[3] is None or time < v[3])]
        best = max(fit, key=lambda v: (v[1], v[2], (v[4] is not None, v[4] or 0), down(v[5])), default=None)
        out.append((key, time, *more, *((best[4], best[1], best[2], best[5]) if best else (None,) * 4)))
    return Counter(out)


def check(spark, versions, asks, **how):
    found = pointintime.as_asked(spark.createDataFrame([(*a, 5) for a in asks], ASK), versions_of(spark, versions), **how)
    got = Counter(tuple(r) for r in found.select("key", "time", "name", "id", "event", "arrival", "note").collect())
    assert got == brute(versions, asks)


def drawn(seed, n, asks, longest, span=3000, keys="aab"):
    own = random.Random(seed)
    versions = []
    for i in range(n):
        event = own.randrange(span)
        versions.append((own.choice(keys), event, event + own.randrange(-60, 200), event + own.randrange(longest), i, own.choice("xyz")))
    return versions, [(own.choice(keys), own.randrange(-50, span + 50), f"n{i}") for i in range(asks)]


def test_short_versions(spark):
    check(spark, *drawn(1, 400, 300, 500), width=200)


@pytest.mark.parametrize("width", [7, 50, 1800])
def test_versions_over_many_cells(spark, width):
    check(spark, *drawn(2, 120, 200, 2500), width=width)


def test_crowded_cells_are_dealt_to_parts(spark):
    check(spark, *drawn(3, 500, 200, 600, span=400), width=100, most=20)


def test_ties_in_event_and_arrival(spark):
    versions = [("a", 10, 12, 30, i, n) for i, n in ((1, "x"), (3, "y"), (2, "z"))] + [("a", 10, 11, 30, 9, "w"), ("a", 10, 12, 13, 4, "v"), ("a", 10, 12, 30, 3, None), ("a", 10, 12, 30, 3, "y")]
    check(spark, versions, [("a", t, "n") for t in range(8, 33)])


def test_edges_of_validity(spark):
    """Usable from the later of event and arrival, not at the expiry; never when it expires before it arrives."""
    versions = [("a", 10, 5, 20, 1, "x"), ("a", 12, 15, 18, 2, "y"), ("a", 11, 40, 30, 3, "z"), ("a", 13, 13, 13, 4, "w")]
    check(spark, versions, [("a", t, "n") for t in range(3, 45)], width=5)


def test_odd_rows(spark):
    versions = [(None, 1, 1, 99, 1, "x"), ("a", None, 1, 99, 2, "x"), ("a", 1, None, 99, 3, "x"), ("a", 2, 2, None, 4, None), ("a", 3, 3, 6, None, "y"), ("a", 3, 3, 6, None, "y"), ("b", -500, -500, None, 6, "z")]
    asks = [("a", 5, "p"), ("a", 5, "p"), ("a", 5, None), ("a", None, "q"), (None, 5, "q"), ("c", 5, "q"), ("a", 7, "q"), ("a", 10**6, "q"), ("b", -499, "r"), ("b", 0, "r")]
    check(spark, versions, asks, width=10)


def test_empty_tables(spark):
    versions, asks = drawn(4, 20, 10, 100)
    check(spark, [], asks)
    check(spark, versions, [])
    check(spark, [], [])
    check(spark, versions, [(None, None, "n")])


def test_tree_plays_winners_upward():
    for n in (0, 1, 2, 3, 5, 8, 33):
        own, tree, active = random.Random(n), pointintime.Tournament(n), set()
        assert tree.winner() is None
        for _ in range(200 if n else 0):
            leaf = own.randrange(n)
            (active.discard if leaf in active else active.add)(leaf)
            tree.put(leaf, leaf in active)
            assert tree.winner() == min(active, default=None)


def test_blocks_of_a_version_are_few(spark):
    """A version over a million cells costs rows in the number of its digits."""
    versions = [("a", i, i, 10**9 + i, i, "x") for i in range(50)]
    check(spark, versions, [("a", t, "n") for t in (0, 10, 49, 10**6, 10**8 + 7, 10**9 - 1, 10**9 + 20, 10**9 + 60)], width=1000)
