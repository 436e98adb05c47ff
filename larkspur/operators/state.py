"""State that advances scan by scan: what is new, changed, missing, disappeared, expired or merged.

A scan is a table; state is a table; each operator gives the next table, so a failed step leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Misses and days after which an item has disappeared, and days after which an unseen one is pruned.
MISSES, WINDOW_DAYS, KEEP_DAYS = 3, 7, 90


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, price: str) -> DataFrame:
    """key, state (new, dropped, changed, same or missing), price_before and price_now; one full outer join on the key."""
    joined = before.select(key, F.col(price).alias("price_before"), F.lit(True).alias("_b")).join(now.select(key, F.col(price).alias("price_now"), F.lit(True).alias("_n")), key, "full")
    dropped = (F.col("price_before") > F.col("price_now")) & (F.col("price_now") > 0)
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "missing").when(dropped, "dropped").when(F.col("price_before").eqNullSafe(F.col("price_now")), "same").otherwise("changed")
    return joined.select(key, state.alias("state"), "price_before", "price_now")


def advance_tracking(tracking: DataFrame, scanned: DataFrame, key: str, now: Column) -> DataFrame:
    """Next tracking (key, first_seen, last_seen, misses): seen items start over at no miss, absent ones miss once more."""
    joined = tracking.join(scanned.select(key).distinct().withColumn("_here", F.lit(True)), key, "full")
    return joined.select(key, F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("_here"), now).otherwise(F.col("last_seen")).alias("last_seen"), F.when(F.col("_here"), 0).otherwise(F.col("misses") + 1).cast("long").alias("misses"))


def disappeared(tracking: DataFrame, scanned: DataFrame, key: str, now: Column, misses: int = MISSES, days: int = WINDOW_DAYS) -> DataFrame:
    """Items that this scan misses for the misses-th time or more and that were first seen within the window (from the state before)."""
    absent = tracking.join(scanned.select(key), key, "left_anti")
    return absent.where((F.col("misses") + 1 >= misses) & (F.col("first_seen") >= now - F.expr(f"INTERVAL {days} DAYS")))


def prune(tracking: DataFrame, favourites: DataFrame, key: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Tracking without items unseen for so many days, favourites excepted."""
    old = tracking.where(F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS")).join(favourites.select(key), key, "left_anti")
    return tracking.join(old.select(key), key, "left_anti")


def fold_tracking(tracking: DataFrame, merged: DataFrame, key: str, profile: str) -> DataFrame:
    """Tracking of merged items as one: the least index, the earliest views, the latest update; missing values don't count."""
    into = merged.select(F.col("loser").alias(key), F.col("winner").alias("_to"))
    moved = tracking.join(into, key, "left").withColumn("winner", F.coalesce("_to", key))
    return moved.groupBy(profile, "winner").agg(F.min("index").alias("index"), F.min("viewed_at").alias("viewed_at"), F.min("favourited_at").alias("favourited_at"), F.max("updated_at").alias("updated_at"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """old with new laid over it; columns in keep_first stay as they were first written."""
    columns = [c for c in old.columns if c != key]
    joined = old.select(key, F.struct(*columns).alias("_o")).join(new.select(key, F.struct(*columns).alias("_n")), key, "full")
    pick = lambda c: F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in keep_first else F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))
    return joined.select(key, *(pick(c).alias(c) for c in columns))


def run_counts(items: DataFrame, **tests: Column) -> DataFrame:
    """Total and how many rows pass each test, in one pass."""
    return items.agg(F.count("*").alias("total"), *(F.count_if(t).alias(n) for n, t in tests.items()))


def source_health(found: DataFrame, enabled: DataFrame, source: str, broken: DataFrame | None = None) -> DataFrame:
    """source, found and health (ok, zero_results or broken) of all enabled sources."""
    counts = enabled.select(source).join(found.groupBy(source).agg(F.count("*").alias("found")), source, "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    if broken is not None:
        counts = counts.join(broken.select(source, F.lit(True).alias("_broken")), source, "left")
    else:
        counts = counts.withColumn("_broken", F.lit(None).cast("boolean"))
    return counts.select(source, "found", F.when(F.col("_broken"), "broken").when(F.col("found") == 0, "zero_results").otherwise("ok").alias("health"))
