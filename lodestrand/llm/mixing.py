"""Mixing sources to target weights: hash-threshold histograms.

Sources share a budget of tokens by weight. Within a source, documents have a fixed place in hash space, and the mix
takes those whose hash is below a threshold. The threshold comes from histograms: tokens are summed by source and by
the leading bits of the hash, the bucket in which the running sum passes the budget is the boundary, and only that
bucket is split by the next bits, until it holds one hash value. Documents are then filtered by the threshold;
nothing is sorted. Thresholds nest: a larger budget takes a superset.

A target above a source's size takes all of it several times and a part of it once more, up to a given multiple.

Null text has size 0, a null source is a source of its own (last), a null id is hashed as such. Repeated rows share a
hash and are taken together. Empty documents are never taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, named_apart

#: Bits of the hash by which a histogram's bucket is split, and hash bits in all.
STEP, BITS = 12, 60
#: Keys over which a source's rows are dealt for a join.
DEALS = 64
#: The result's columns beside those kept.
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, salt: str = "") -> Column:
    """A document's place in hash space: the first 60 bits of md5, the same in any SQL engine."""
    text = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Add weight and target to a table of source and source_size, one row for each source.

    Weights repeat over the sources in order of code points, null last. No target exceeds most times its source;
    what that leaves over goes to the others by weight. Equivalently all targets are weight times one level, cut at
    their limits: sources reach their limits in order of limit by weight, so the level follows from running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    limited = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "weight", F.encode("source", "UTF-8"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(share) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and all of greater need were below their limits; it holds from the first one that is.
    free = limited.withColumn("own_level", left / weight_left)
    free = free.withColumn("below", F.col("own_level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("below"), F.struct(F.col("limit") / F.col("weight"), F.col("weight"), F.col("own_level").alias("level")))).over(everything)["level"]
    return free.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "weight", "target")


def _dealt(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Join items with a few rows by source; a hot source's items are dealt to DEALS keys by their hash."""
    keys = few.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return rows.withColumn("deal", F.pmod("place", F.lit(DEALS)).cast("int")).join(keys, ["source_key", "deal"]).drop("deal")


def thresholds(items: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """For each source (column source_key) the hash below which documents are taken.

    items: source_key, place, size. budgets: source_key, budget. The sizes of the documents below the returned place
    come as near to the budget as a threshold allows.
    """
    state = budgets.select("source_key", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"))
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("place", shift)
        # The first histogram is of the whole source, each later one only of the boundary bucket.
        near = items if shift == BITS - STEP else _dealt(items, state.select("source_key", F.shiftright("low", shift + STEP).alias("of"))).filter(F.shiftright("place", shift + STEP) == F.col("of"))
        histogram = near.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket"))
        passed = histogram.withColumn("running", running).join(state, "source_key").filter(F.col("taken") + F.col("running") <= F.col("budget"))
        last = passed.groupBy("source_key").agg(F.max("running").alias("more"), F.max("bucket").alias("full"))
        # The boundary is the bucket after the last full one that holds rows; empty ones before it add nothing.
        after = histogram.join(last, "source_key", "left").filter(F.col("bucket") > F.coalesce("full", F.lit(-1)))
        boundary = after.groupBy("source_key").agg(F.min("bucket").alias("boundary"))
        state = (
            state.join(last, "source_key", "left")
            .join(boundary, "source_key", "left")
            .select(
                "source_key",
                "budget",
                F.coalesce(F.shiftleft("boundary", shift), F.shiftleft(F.col("full") + 1, shift), F.col("low")).alias("low"),
                (F.col("taken") + F.coalesce("more", F.lit(0))).alias("taken"),
            )
        )
        state = scratch.save(state, f"state-{shift}")
    # The boundary's own rows come in too where that is nearer to the budget.
    edge = _dealt(items, state).filter(F.col("place") == F.col("low")).groupBy("source_key").agg(F.sum("size").alias("edge"))
    gap = F.col("budget") - F.col("taken")
    nearer = F.coalesce(F.col("edge") - gap < gap, F.lit(False)).cast("long")
    return state.join(edge, "source_key", "left").select("source_key", (F.col("low") + nearer).alias("below"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    salt: str = "",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (the words that the mix takes, repeats counted).

    keep names columns to carry along, which must not have a name of the result's (ValueError). The histograms read sizes and places only; these are written once, and again
    computed from the text only where columns are carried, so that no text is written here.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    carried = named_apart(keep, RESULT)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), place(F.col(id_col), salt).alias("place"), *[F.col(f"`{c}`").alias(k) for c, k in carried.items()])
    named = named.withColumn("source_key", key)
    items = scratch.save(named.select("doc_id", "source", "size", "place", "source_key"), "sizes")
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = scratch.save(targets(sums, weights, share, most).withColumn("source_key", key), "targets", release=False)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    shares = shares.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    limits = scratch.save(thresholds(items, shares, scratch), "thresholds", release=False)
    plan = shares.drop("source").join(limits, "source_key")
    taken = F.col("size") * (F.col("rounds") + F.when(F.col("place") < F.col("below"), 1).otherwise(0))
    rows = _dealt(named if keep else items, plan)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[F.col(k).alias(c) for c, k in carried.items()])
