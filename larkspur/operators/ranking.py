"""Scores, orders and standings of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import clamp, half_even, half_up, known
from larkspur.operators.steps import Steps

# Price per square metre that scores 0, and what it loses a point.
FULL_PRICE_PER_M2, PER_POINT = 550, 2.5


def match_score(price: Column, size: Column, land: Column, layout: Column, in_preferred_place: Column, weights: dict[str, float], preferred: dict) -> Column:
    """Weighted score of six parts, each from 0 to 100; a part whose fact or preferred value is missing is left out, the place never is.

    weights: price_per_m2, layout, size, place, land, price; preferred: layouts, size, land, price.
    """
    value = {k: preferred.get(k) for k in ("size", "land", "price")}
    parts = {
        "price_per_m2": (price.isNotNull() & known(size), clamp((FULL_PRICE_PER_M2 - price / F.nullif(size, F.lit(0))) / PER_POINT, 0, 100)),
        "layout": (layout.isNotNull(), F.when(layout.isin(preferred.get("layouts", [])), 100.0).otherwise(0.0)),
        "size": (known(size) & F.lit(bool(value["size"])), F.least(F.lit(100.0), size / F.lit(float(value["size"] or 1)) * 100)),
        "place": (F.lit(True), F.when(F.coalesce(in_preferred_place, F.lit(False)), 100.0).otherwise(0.0)),
        "land": (known(land) & F.lit(bool(value["land"])), F.least(F.lit(100.0), land / F.lit(float(value["land"] or 1)) * 100)),
        "price": (known(price) & F.lit(bool(value["price"])), clamp((2 - price / F.lit(float(value["price"] or 1))) * 100, 0, 100)),
    }
    terms = [F.when(there, F.lit(float(weights[name])) / 100 * value).otherwise(0.0) for name, (there, value) in parts.items() if weights.get(name)]
    return half_even(reduce(Column.__add__, terms, F.lit(0.0)))


def ordered(items: DataFrame, by: str, newest: str, id_: str, descending: bool = True) -> DataFrame:
    """Missing values last either way; ties newest first, then by id."""
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return items.orderBy(first, F.desc(newest), F.asc(id_))


def top_k(items: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows and their rank; one ordered take, not a window over all rows."""
    head = items.orderBy(*order).limit(k)
    return head.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))


def budget_per_group(items: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in the given order, with their rank."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def ranked_overall(items: DataFrame, *order: Column) -> DataFrame:
    """All rows and their rank in one order over all of them.

    Rows are dealt by ranges of the order and numbered in their range, from the number of rows in the ranges before: no task holds
    more than a range, and of the counts there is a row for each range.
    """
    steps = Steps(items.sparkSession, "ranked")
    dealt = steps.written(steps.written(items).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = dealt.join(starts, F.col("_range") == F.col("_r")).withColumn("rank", (F.col("_before") + place).cast("long"))
    return steps.last(numbered.select(*items.columns, "rank"))


def running_index(items: DataFrame, group: str, *order: Column, start: int = 0) -> DataFrame:
    return items.withColumn("index", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) + start).cast("long"))


def _ranked(counts: DataFrame, group: str, value: str, steps: Steps) -> DataFrame:
    """counts (group, value, same) with below: how many known values of the group lie below, as sums over ranges of values.

    Values are dealt by ranges, so those of a group lie in many tasks; each range of a group is summed by itself, and starts from
    the sums of the ranges before, of which there is a row for each group and range at most.
    """
    dealt = counts.repartitionByRange(F.col(group).asc_nulls_first(), F.col(value)).withColumn("_range", F.spark_partition_id())
    dealt = steps.written(dealt)
    sums = dealt.groupBy(group, "_range").agg(F.sum("same").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = dealt.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    own = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(group, value, "same", (F.col("_before") + F.coalesce(F.sum("same").over(own), F.lit(0))).alias("below"))


def standing(items: DataFrame, group: str, value: str) -> DataFrame:
    """How each row stands among the others of its group that have a known value; all rows come back.

    others (how many), below_percent and above_percent (strict, of the others), is_lowest, is_highest, lowest and highest (its own value
    counts), middle (the median of the others) and middle_percent (how far the value is from it).  All are null where the value is
    unknown or no other is known, but others, which is 0 there, and is_lowest and is_highest, which are false.

    Without one copy of a value the k-th of a group is its k-th, or from that value on its (k + 1)-th, so a row needs the
    counts below its value and four order statistics of its group.  They come from counts of each value and sums over ranges of
    them: no task holds the rows of a group, or the values of a large one.
    """
    steps = Steps(items.sparkSession, "standing")
    counts = items.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_group"), F.col(value).alias("_value")).agg(F.count("*").alias("same"))
    ranked = steps.written(_ranked(counts, "_group", "_value", steps))
    total = ranked.groupBy("_group").agg(F.sum("same").alias("_n"), F.min("_value").alias("lowest"), F.max("_value").alias("highest"))
    both = ranked.join(total.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    n = F.col("_n")
    # of n - 1 others the middle ones are number a and b
    a, b = F.floor(n / 2), F.floor((n + 1) / 2)
    at = lambda k, name: F.max(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("same")), F.col("_value"))).alias(name)
    middles = both.groupBy(F.col("_group").alias("_g")).agg(at(a, "_a0"), at(a + 1, "_a1"), at(b, "_b0"), at(b + 1, "_b1"))
    both = both.join(middles, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    v = F.col("_value")
    low, high = F.when(v > F.col("_a0"), F.col("_a0")).otherwise(F.col("_a1")), F.when(v > F.col("_b0"), F.col("_b0")).otherwise(F.col("_b1"))
    others, above = n - 1, n - F.col("below") - F.col("same")
    some = others > 0
    percent = lambda x: F.when(some, half_up(100.0 * x / others))
    middle = F.when(some, (low + high) / 2)
    facts = both.select(
        "_group",
        "_value",
        others.cast("long").alias("others"),
        percent(F.col("below")).alias("below_percent"),
        percent(above).alias("above_percent"),
        (some & (F.col("below") == 0) & (F.col("same") == 1)).alias("is_lowest"),
        (some & (above == 0) & (F.col("same") == 1)).alias("is_highest"),
        F.when(some, F.col("lowest")).alias("lowest"),
        F.when(some, F.col("highest")).alias("highest"),
        middle.alias("middle"),
        F.when(middle != 0, half_up(100.0 * (v - middle) / middle)).alias("middle_percent"),
    )
    joined = items.join(steps.last(facts), F.col(group).eqNullSafe(F.col("_group")) & (F.col(value) == F.col("_value")), "left").drop("_group", "_value")
    return joined.withColumn("others", F.coalesce("others", F.lit(0).cast("long"))).withColumn("is_lowest", F.coalesce("is_lowest", F.lit(False))).withColumn("is_highest", F.coalesce("is_highest", F.lit(False)))


def facet_scale(items: DataFrame, value: str, step: float, most: int = 20) -> DataFrame:
    """A slider for a value: low and high on whole steps and at most about ``most`` stops; no row if there is nothing to slide."""
    found = items.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo < hi")
    found = found.select((F.floor(F.col("lo") / step) * step).alias("low"), (F.ceil(F.col("hi") / step) * step).alias("high"))
    wide = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / step / most)) * step
    return found.withColumn("stop", wide).withColumn("stops", (F.ceil((F.col("high") - F.col("low")) / F.col("stop")) + 1).cast("long"))


def cheapest_of_group(items: DataFrame, group: str, price: str, seen: str, id_: str, *values: str) -> DataFrame:
    """The row shown for each group: known prices first, then the lowest, the first seen, the least id."""
    key = F.struct(F.col(price).isNull().alias("missing"), F.coalesce(F.col(price), F.lit(0)).alias("price"), F.col(seen).alias("seen"), F.col(id_).alias("id"))
    shown = F.min_by(F.struct(price, seen, id_, *values), key).alias("_shown")
    found = items.groupBy(group).agg(shown, F.min(seen).alias("first_seen"), F.count("*").alias("members"))
    return found.select(group, *(F.col(f"_shown.{c}").alias(c) for c in (price, id_, *values)), "first_seen", "members")


def inbox_place(favourited: Column, updated: Column, viewed: Column, seen: Column) -> Column:
    """Section and its date: favourite before updated before viewed before new."""
    section = lambda name, at: F.struct(F.lit(name).alias("section"), at.alias("at"))
    return F.when(favourited.isNotNull(), section("favourite", favourited)).when(updated.isNotNull(), section("updated", updated)).when(viewed.isNotNull(), section("viewed", viewed)).otherwise(section("new", seen))
