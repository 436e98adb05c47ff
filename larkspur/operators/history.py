"""Price history over an append-only log of observations (key, at, id, price).

Every operator takes the names of the columns.  Order within a key is (at, id); one key may be hot, so latest values are
aggregates with map-side combine and only operators that need the row before use a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, at: str, id_: str, *values: str) -> DataFrame:
    """The last observation of each key."""
    found = log.groupBy(key).agg(F.max(F.struct(at, id_, *values)).alias("_last"))
    return found.select(key, F.col(f"_last.{at}").alias(at), *(F.col(f"_last.{v}").alias(v) for v in values))


def previous_different(log: DataFrame, key: str, at: str, id_: str, price: str) -> DataFrame:
    """key, price (the latest) and previous (the latest that differs from it; null if none does).

    The latest of each price, of those the latest, and then the latest of the others: nothing is collected.
    """
    each = log.groupBy(key, price).agg(F.max(F.struct(at, id_)).alias("_at"))
    last = each.groupBy(key).agg(F.max_by(F.struct(price), "_at").alias("_last"))
    own = last.select(F.col(key).alias("_key"), "_last")
    others = each.join(own, F.col(key).eqNullSafe(F.col("_key"))).where(~F.col(price).eqNullSafe(F.col(f"_last.{price}")))
    before = others.groupBy(F.col("_key")).agg(F.max_by(F.struct(price), "_at").alias("_before"))
    found = last.join(before, F.col(key).eqNullSafe(F.col("_key")), "left")
    return found.select(key, F.col(f"_last.{price}").alias(price), F.col(f"_before.{price}").alias("previous"))


def with_drop(latest_and_previous: DataFrame, price: str) -> DataFrame:
    """drop_from: the previous price where it is higher than the latest."""
    return latest_and_previous.withColumn("drop_from", F.when(F.col("previous") > F.col(price), F.col("previous")))


def _order(key: str, at: str, id_: str):
    return Window.partitionBy(key).orderBy(at, id_)


def price_runs(log: DataFrame, key: str, at: str, id_: str, price: str, last: tuple[str, ...] = ()) -> DataFrame:
    """Runs of equal prices: run (from 1), price, first_seen_at, last_seen_at and the last value of other columns."""
    w = _order(key, at, id_)
    changed = F.coalesce(~F.col(price).eqNullSafe(F.lag(price).over(w)) | F.lag(at).over(w).isNull(), F.lit(True))
    runs = log.withColumn("run", F.sum(changed.cast("int")).over(w).cast("long"))
    more = [F.max_by(c, F.struct(at, id_)).alias(c) for c in last]
    return runs.groupBy(key, "run").agg(F.first(price).alias(price), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), *more)


def price_changes(runs: DataFrame, key: str, price: str) -> DataFrame:
    """key, seen_at, price_from, price_to of each change between runs."""
    w = Window.partitionBy(key).orderBy("run")
    pairs = runs.select(key, F.col("first_seen_at").alias("seen_at"), F.lag(price).over(w).alias("price_from"), F.col(price).alias("price_to"), "run")
    return pairs.where("run > 1").drop("run")


def held_until(runs: DataFrame, key: str) -> DataFrame:
    """Until when each run's price held: the start of the next run, or its own last observation."""
    w = Window.partitionBy(key).orderBy("run")
    return runs.withColumn("held_until", F.coalesce(F.lead("first_seen_at").over(w), F.col("last_seen_at")))


def as_of(moments: DataFrame, log: DataFrame, key: str, moment: str, at: str, id_: str, price: str) -> DataFrame:
    """moments with the price of the last observation of the key at or before the moment.

    Both sides are laid on one time line and the last observation is carried forward: a shuffle by key and no range join.
    """
    names = moments.columns
    left = moments.select(F.struct(*names).alias("_row"), F.col(key).alias("_k"), F.col(moment).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(log.schema[id_].dataType).alias("_id"), F.lit(None).cast(log.schema[price].dataType).alias("_p"), F.lit(None).cast("struct<x:boolean>").alias("_seen"))
    right = log.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(id_).alias("_id"), F.col(price).alias("_p"), F.struct(F.lit(True).alias("x")).alias("_seen"))
    w = Window.partitionBy("_k").orderBy("_at", "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_seen").isNotNull(), F.struct("_p")), ignorenulls=True).over(w)
    both = left.unionByName(right).withColumn("_carried", carried).where("_side = 1")
    return both.select(*(F.col(f"_row.{c}").alias(c) for c in names), F.col("_carried._p").alias("as_of_" + price))


def chart_extent(runs: DataFrame, key: str, price: str) -> DataFrame:
    return runs.groupBy(key).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.min("first_seen_at").alias("since"), F.max("last_seen_at").alias("until"))


def nested_runs(runs: DataFrame, key: str, price: str) -> DataFrame:
    """One row a key with its runs as an array in order."""
    return runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", price, "first_seen_at", "last_seen_at"))).alias("changes"))


def event_history(changes: DataFrame, found: DataFrame, key: str, at: str) -> DataFrame:
    """Found and price-change events of each key, newest first: place (from 1), kind, seen_at, price_from, price_to."""
    first = found.select(key, F.col(at).alias("seen_at"), F.lit("found").alias("kind"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("price_from"), F.lit(None).cast("long").alias("price_to"))
    rest = changes.select(key, "seen_at", F.lit("price_change").alias("kind"), F.lit(1).alias("_o"), F.col("price_from").cast("long").alias("price_from"), F.col("price_to").cast("long").alias("price_to"))
    w = Window.partitionBy(key).orderBy(F.desc("seen_at"), "_o")
    return first.unionByName(rest).withColumn("place", F.row_number().over(w).cast("long")).drop("_o")


