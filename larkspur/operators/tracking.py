"""What a scan means for what is tracked: new, dropped and updated flats, their identity, and the tracked read model.

A flat is a group of postings: ``members`` has keeper, id, seq (0 for the keeper, then in the order of merging), price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import known
from larkspur.operators import history, ranking
from larkspur.operators.steps import Steps


def members_of(survivors: DataFrame, merges: DataFrame) -> DataFrame:
    """keeper, id and seq of all postings: survivors (id) and those merged into them (absorbed, keeper, seq from 1)."""
    return survivors.select(F.col("id").alias("keeper"), "id", F.lit(0).cast("long").alias("seq")).union(merges.select("keeper", F.col("absorbed"), F.col("seq").cast("long")))


def grouped_members(members: DataFrame) -> DataFrame:
    """keeper and its members in order, the keeper first."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "id")))
    return members.groupBy("keeper").agg(F.transform(ordered, lambda m: m["id"]).alias("members"))


def current_ids(survivors: DataFrame, merges: DataFrame) -> DataFrame:
    return survivors.select("id").union(merges.select("absorbed")).distinct()


def classify(members: DataFrame, seen: DataFrame, viewed: DataFrame, prices: DataFrame) -> DataFrame:
    """keeper, is_new, drop_from and is_updated.

    New: none of its members was seen or viewed.  Dropped (by the keeper's own posting): not new, and the old price is higher than the
    price, both known.  Updated: some member was viewed, and some is unseen or has another known price than before.
    """
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    rows = members.join(flag(seen, "_seen"), "id", "left").join(flag(viewed, "_viewed"), "id", "left").join(prices.select("id", F.col("price").alias("_old")), "id", "left")
    both = known(F.col("_old")) & known(F.col("price"))
    changed = F.col("_seen").isNull() | (both & (F.col("_old") != F.col("price")))
    own = F.col("id") == F.col("keeper")
    any_of = lambda test: F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False))
    found = rows.groupBy("keeper").agg(
        any_of(F.col("_seen").isNotNull() | F.col("_viewed").isNotNull()).alias("_known"),
        any_of(F.col("_viewed").isNotNull()).alias("_looked"),
        any_of(changed).alias("_changed"),
        F.max(F.when(own & both & (F.col("_old") > F.col("price")), F.col("_old"))).alias("_from"),
    )
    return found.select("keeper", (~F.col("_known")).alias("is_new"), F.when(F.col("_known"), F.col("_from")).alias("drop_from"), (F.col("_looked") & F.col("_changed")).alias("is_updated"))


def identities(members: DataFrame, owned: DataFrame, scan: str) -> tuple[DataFrame, DataFrame]:
    """(keeper, property, created) and (loser, winner).

    The property of a flat is the first that one of its members has, in their order; else a new one, whose id is a hash of the keeper
    and the scan, so that a repeated scan gives the same.  Other properties of its members fold into it.  owned: id, property.
    """
    rows = members.join(owned.select("id", "property"), "id", "left")
    first = rows.groupBy("keeper").agg(F.min_by("property", F.when(F.col("property").isNotNull(), F.struct("seq", "id"))).alias("_found"))
    new = F.sha2(F.concat_ws("|", F.lit(scan), F.col("keeper").cast("string")), 256)
    found = first.select("keeper", F.coalesce(F.col("_found").cast("string"), new).alias("property"), F.col("_found").isNull().alias("created"))
    losers = rows.where("property is not null").select("keeper", F.col("property").cast("string").alias("loser")).distinct()
    folds = losers.join(found.select("keeper", F.col("property").alias("winner")), "keeper").where("loser <> winner").select("loser", "winner").distinct()
    return found, folds


def reduce_actions(log: DataFrame, *key: str) -> DataFrame:
    """key, viewed_at, favourited_at and updated_at after a log of actions (key, at, seq, action: view, update, favourite, clear).

    Viewing sets the first time only and clears the update; a favourite keeps its first time since it was last cleared, and is viewed.
    """
    at = F.struct("at", "seq")
    last = lambda action: F.max(F.when(F.col("action") == action, at))
    own = Window.partitionBy(*key)
    rows = log.withColumn("_cleared", F.max(F.when(F.col("action") == "clear", at)).over(own))
    kept = (F.col("action") == "favourite") & (F.col("_cleared").isNull() | (at > F.col("_cleared")))
    found = rows.groupBy(*key).agg(F.min(F.when(F.col("action").isin("view", "favourite"), at)).alias("_v"), F.min(F.when(kept, at)).alias("_f"), last("update").alias("_u"), last("view").alias("_seen"))
    updated = F.when(F.col("_seen").isNull() | (F.col("_u") > F.col("_seen")), F.col("_u.at"))
    return found.select(*key, F.col("_v.at").alias("viewed_at"), F.col("_f.at").alias("favourited_at"), updated.alias("updated_at"))


def tracked_properties(tracking: DataFrame, listings: DataFrame, listing_tracking: DataFrame, prices: DataFrame, only_new: bool = False) -> DataFrame:
    """One row for each property a profile tracks: its cheapest listing, price, drop_from, first_seen and the sources of the others.

    tracking: profile, property, index, viewed_at and so on; listings: id, property, source, url; listing_tracking: profile, id,
    first_seen; prices: id, at, n, price.  All joins are on keys; prices are reduced to a row a listing before they are joined.
    """
    rows = (tracking.where("viewed_at is null") if only_new else tracking).join(listings, "property").join(listing_tracking, ["profile", "id"])
    drops = history.with_drop(history.previous_different(prices, "id", "at", "n", "price"), "price")
    rows = rows.join(drops.select("id", "price", "drop_from"), "id", "left")
    key = F.struct(F.col("price").isNull().alias("missing"), F.coalesce("price", F.lit(0)).alias("p"), "first_seen", "id")
    facts = [c for c in tracking.columns if c not in ("profile", "property")]
    found = rows.groupBy("profile", "property").agg(F.min_by(F.struct("id", "source", "url", "price", "drop_from"), key).alias("_shown"), F.min("first_seen").alias("first_seen"), *(F.any_value(c).alias(c) for c in facts), F.array_sort(F.collect_list(F.struct("source", "id", "url"))).alias("_all"))
    others = F.transform(F.filter("_all", lambda x: x["id"] != F.col("_shown.id")), lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url")))
    return found.select("profile", "property", *facts, F.col("_shown.id").alias("listing"), "_shown.source", "_shown.url", "_shown.price", "_shown.drop_from", "first_seen", others.alias("siblings"))


def without_listings(tracking: DataFrame, listings: DataFrame, listing_tracking: DataFrame) -> DataFrame:
    """Property tracking without properties of which the profile tracks no listing any more, favourites excepted."""
    held = listing_tracking.join(listings.select("id", "property"), "id").select("profile", "property").distinct()
    return tracking.where("favourited_at is not null").unionByName(tracking.where("favourited_at is null").join(held, ["profile", "property"], "left_semi"))


def remembered(properties: DataFrame, wanted: DataFrame) -> DataFrame:
    """Properties (id, merged_into) that are wanted (id) or into which one that stays was folded, however often: in rounds up the folds."""
    steps = Steps(properties.sparkSession, "remembered")
    frontier = staying = steps.written(properties.select("id").join(wanted.select("id").distinct(), "id", "left_semi"))
    up = properties.where("merged_into is not null").select("id", "merged_into")
    while True:
        more = frontier.join(up, "id").select(F.col("merged_into").alias("id")).distinct()
        frontier = steps.written(more.join(properties.select("id"), "id", "left_semi").join(staying, "id", "left_anti"))
        if frontier.isEmpty():
            return steps.last(properties.join(staying, "id", "left_semi"))
        staying = steps.written(staying.union(frontier))


def latest_health(checks: DataFrame, source: str = "source", at: str = "at", *values: str) -> DataFrame:
    return checks.groupBy(source).agg(F.max(F.struct(at, *values)).alias("_c")).select(source, *(F.col(f"_c.{v}").alias(v) for v in (at, *values)))


def new_or_updated(viewed_at: Column, updated_at: Column) -> Column:
    return viewed_at.isNull() | updated_at.isNotNull()


SECTIONS = ("new", "updated", "favourite", "viewed")


def inbox(rows: DataFrame, id_: str) -> DataFrame:
    """Rows with section, its place among the sections and rank: sections in fixed order, in each the latest date first, then by id."""
    place = ranking.inbox_place(F.col("favourited_at"), F.col("updated_at"), F.col("viewed_at"), F.col("first_seen"))
    out = rows.withColumn("_p", place).withColumn("section", F.col("_p.section")).withColumn("placed_at", F.col("_p.at")).drop("_p")
    section = F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), F.col("section"))
    own = Window.partitionBy("profile", "section").orderBy(F.desc("placed_at"), F.asc(id_))
    return out.withColumn("section_place", section.cast("int")).withColumn("rank", F.row_number().over(own).cast("long"))


def full_history(found: DataFrame, postings: DataFrame, tracked: DataFrame) -> DataFrame:
    """property, place (from 1, newest first), kind, at, source, price_from, price_to.

    found: property, listing (the one it is shown by), first_seen; postings: property, listing, source, run, price, first_seen_at (price
    runs); tracked: property, viewed_at, favourited_at.  Kinds: found; posted (a portal's first price after the flat was found);
    price_change (source is null for the listing shown); viewed; favourite.  Of equal times in that order.
    """
    none = {"source": F.lit(None).cast("string"), "price_from": F.lit(None).cast("long"), "price_to": F.lit(None).cast("long")}

    def event(df: DataFrame, o: int, kind: str, at: str, **own: Column) -> DataFrame:
        return df.select("property", F.lit(o).alias("_o"), F.lit(kind).alias("kind"), F.col(at).alias("at"), *(own.get(c, v).alias(c) for c, v in none.items()))

    runs = postings.withColumn("price_from", F.lag("price").over(Window.partitionBy("property", "listing").orderBy("run")))
    runs = runs.join(found.select("property", F.col("listing").alias("_shown"), F.col("first_seen").alias("_found")), "property")
    shown = F.when(F.col("listing") != F.col("_shown"), F.col("source"))
    every = event(found, 0, "found", "first_seen")
    every = every.union(event(runs.where("run = 1 and first_seen_at > _found"), 1, "posted", "first_seen_at", source=F.col("source")))
    every = every.union(event(runs.where("run > 1"), 2, "price_change", "first_seen_at", source=shown, price_from=F.col("price_from").cast("long"), price_to=F.col("price").cast("long")))
    every = every.union(event(tracked.where("viewed_at is not null"), 3, "viewed", "viewed_at")).union(event(tracked.where("favourited_at is not null"), 4, "favourite", "favourited_at"))
    order = Window.partitionBy("property").orderBy(F.desc("at"), "_o", "source", "price_from", "price_to")
    return every.withColumn("place", F.row_number().over(order).cast("long")).drop("_o")


def changes_since(events: DataFrame, since: Column) -> DataFrame:
    """New portals and new prices after a time."""
    return events.where(F.col("kind").isin("posted", "price_change") & (F.col("at") > since))


def last_of_runs(rows: DataFrame, value: str, *order: str, by: tuple[str, ...]) -> DataFrame:
    """The last row of each run of equal values, in the given order within ``by``, of which there must be a column: the runs of a whole
    table would be one task's work."""
    if not by:
        raise ValueError("runs are those of some key")
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_next", F.lead(F.struct(value)).over(w)).where(F.col("_next").isNull() | ~F.col(f"_next.{value}").eqNullSafe(F.col(value))).drop("_next")
