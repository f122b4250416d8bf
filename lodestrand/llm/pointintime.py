"""Point-in-time feature join: tournament-tree sweep.

An ask (key, time) wants the best version of its key that is usable then. A version is usable from its start (the later
of event and arrival) until before its expiry; the latest event is best, then the latest arrival, then the largest id.
Time is cut into cells of one width. In a cell of a key the versions are the leaves of a tournament tree in the order of
their rank. The sweep takes starts, expiries and asks in the order of time: a leaf becomes active or inactive, winners
are played upward until one stays the same, and an ask reads the root.

Versions go to the cells where they start and end, and to a cell between if there is only one. Longer ones cover whole
cells: these are cut into blocks of 1, 2, 4, ... cells, of which a version has two for each size at most, and each block
keeps its best version alone, summed before rows move. A cell that is asked for plays the best of the blocks around it
as one more leaf. So a version costs a bounded number of rows, however long it holds.

Cells with more than `most` versions are dealt to parts by hash, each with a tree of its own; each ask goes to all parts
and takes the best of their winners. Asks that are equal are one row. So no key and no cell is one task, and nothing is
broadcast.

Null keys, times or ids of times: a version without key, event or arrival is never usable, and an ask without key or time
has no winner. A null expiry never comes. Repeated versions are one; equal ones with other payloads are ranked by the
payload, nulls last. Empty tables give no winners. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a cell, and versions that one tree holds.
WIDTH, MOST = 1800, 1 << 15
#: What versions are ranked by, best first; payload columns follow.
RANK = ["event", "arrival", "id"]


class Tournament:
    """Leaves in the order of their rank, 0 best; node 1 is the root, and a node holds its best active leaf."""

    def __init__(self, leaves: int):
        self.size = 1 << max(leaves - 1, 0).bit_length()
        self.none = self.size
        self.best = [self.none] * (2 * self.size)

    def put(self, leaf: int, active: bool) -> None:
        """Activate or deactivate a leaf; winners change upward until one stays."""
        best, at = self.best, self.size + leaf
        best[at] = leaf if active else self.none
        while at > 1:
            at >>= 1
            winner = min(best[2 * at], best[2 * at + 1])
            if best[at] == winner:
                break
            best[at] = winner

    def winner(self) -> int | None:
        """The best active leaf."""
        return None if self.best[1] == self.none else self.best[1]


def sweep(starts: list[int], ends: list[int], times: list[int]) -> list[int | None]:
    """For each time the least version that is active; versions are numbered by rank and active from start to before end."""
    tree = Tournament(len(starts))
    changes = sorted([(t, 1, i) for i, t in enumerate(starts)] + [(t, 0, i) for i, t in enumerate(ends)])
    out: list[int | None] = [None] * len(times)
    at = 0
    for t, i in sorted((t, i) for i, t in enumerate(times)):
        upto = bisect_left(changes, (t + 1,), at)
        for _, active, leaf in changes[at:upto]:
            tree.put(leaf, bool(active))
        at = upto
        out[i] = tree.winner()
    return out


def _payload(versions: DataFrame) -> list[str]:
    return [c for c in versions.columns if c not in ("key", "event", "arrival", "expiry", "id")]


def _ranked(payload: list[str]) -> Column:
    """A struct by which the best version is the largest."""
    return F.struct(*RANK, *payload)


def latest(versions: DataFrame, asks: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """key, time, and the winner's id, event, arrival and payload, for every different ask that has a winner.

    versions: key, event, arrival, expiry (integers), id and any columns of payload that have an order; asks: key and time.
    """
    payload = _payload(versions)
    asked = asks.select("key", F.col("time").cast("long").alias("time")).filter("key is not null and time is not null").distinct()
    first, last = asked.agg(F.min("time"), F.max("time")).first()
    usable = versions.withColumn("start", F.greatest("event", "arrival").cast("long")).filter("key is not null and event is not null and arrival is not null")
    if first is None:
        first, last = 0, -1
    # Only what holds between the first and the last ask; an open end is behind the last.
    usable = usable.withColumn("start", F.greatest("start", F.lit(first))).withColumn("end", F.least(F.coalesce(F.col("expiry").cast("long"), F.lit(last + 1)), F.lit(last + 1))).filter("start < end")
    cell = lambda c: F.floor((c - first) / width).cast("long")
    usable = usable.withColumn("from", cell(F.col("start"))).withColumn("upto", cell(F.col("end") - 1)).select("key", *RANK, *payload, "start", "end", "from", "upto")
    short = F.col("upto") - F.col("from") <= 2
    here = F.array_distinct(F.when(short, F.sequence("from", "upto")).otherwise(F.array("from", "upto")))
    leaves = usable.withColumn("cell", F.explode(here)).select("key", "cell", *RANK, *payload, "start", "end")
    asked = asked.withColumn("cell", cell(F.col("time")))
    levels = range(max(1, int((last - first) // width + 1).bit_length()))
    leaves = leaves.unionByName(_covering(usable.filter(~short), asked, payload, levels, first, width))

    crowded = leaves.groupBy("key", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    crowded = crowded.select("key", "cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))

    def dealt(rows: DataFrame, part: Column) -> DataFrame:
        joined = rows.join(crowded.hint("merge"), ["key", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return joined.withColumn("part", part).drop("parts")

    one = dealt(leaves, F.pmod(F.xxhash64("id", "start"), F.col("parts")).cast("int")).withColumn("time", F.lit(None).cast("long"))
    other = dealt(asked, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kinds = {f.name: f.dataType for f in leaves.schema}
    # What a group does not compute it passes on by the number of its row.
    out = T.StructType([T.StructField("key", kinds["key"]), T.StructField("time", T.LongType()), *[T.StructField(c, kinds[c]) for c in [*RANK, *payload]]])

    def run(group: pa.Table) -> pa.Table:
        is_ask = group.column("time").is_valid()
        own, wanted = group.filter(pc.invert(is_ask)), group.filter(is_ask)
        own = own.take(_order(own, payload))
        times = wanted.column("time").to_pylist()
        found = sweep(own.column("start").to_pylist(), own.column("end").to_pylist(), times)
        some = [i for i, w in enumerate(found) if w is not None]
        winners = own.take(pa.array([found[i] for i in some], pa.int64()))
        asks = wanted.take(pa.array(some, pa.int64()))
        return pa.table([asks.column("key"), asks.column("time"), *[winners.column(c) for c in [*RANK, *payload]]], names=out.names)

    met = one.unionByName(other, allowMissingColumns=True).groupBy("key", "cell", "part").applyInArrow(run, out)
    best = met.groupBy("key", "time").agg(F.max(_ranked(payload)).alias("best"))
    return best.select("key", "time", "best.*")


def _order(rows: pa.Table, payload: list[str]) -> pa.Array:
    """The rows' places, the best first."""
    return pc.sort_indices(rows, sort_keys=[(c, "descending") for c in [*RANK, *payload]], null_placement="at_end")


def _covering(long: DataFrame, asked: DataFrame, payload: list[str], levels: range, first: int, width: int) -> DataFrame:
    """For each cell that is asked for, the best of the versions that hold all through it and more, active in all of it."""
    a, b = F.col("from") + 1, F.col("upto")  # cells a to before b are covered
    blocks = []
    for k in levels:
        low, high = F.floor((a + (1 << k) - 1) / (1 << k)).cast("long"), F.floor(b / (1 << k)).cast("long")
        blocks.append(F.when((low < high) & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("block"))))
        blocks.append(F.when((low < high) & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("block"))))
    blocks = F.filter(F.array(*blocks), lambda x: x.isNotNull())
    held = long.withColumn("at", F.explode(blocks)).groupBy("key", "at.level", "at.block").agg(F.max(_ranked(payload)).alias("best"))
    above = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("cell", k).alias("block")) for k in levels])
    wanted = asked.select("key", "cell").distinct().withColumn("at", F.explode(above)).select("key", "cell", "at.level", "at.block")
    best = wanted.join(held.hint("merge"), ["key", "level", "block"]).groupBy("key", "cell").agg(F.max("best").alias("best"))
    begin = F.lit(first) + F.col("cell") * width
    return best.select("key", "cell", "best.*", begin.alias("start"), (begin + width).alias("end"))


def as_asked(asks: DataFrame, versions: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Every row of asks (key, time and more) with its winner's id, event, arrival and payload, null without a winner."""
    found = latest(versions, asks, width, most).withColumnsRenamed({"key": "own_key", "time": "own_time"})
    match = (F.col("key") == F.col("own_key")) & (F.col("time") == F.col("own_time"))
    return asks.join(found.hint("merge"), match, "left").drop("own_key", "own_time")
