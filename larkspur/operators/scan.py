"""A scan from its sources to its commit: read in isolation, filter, link, compare with what is tracked, and commit it all or nothing.

State is two tables of a ``commit.Store``: ``tracking`` (id, first_seen, last_seen, misses) and ``prices`` (id, price: the last known
one).  A scan of which no source answered commits nothing, so that what it could not see isn't counted as missed; a dry run commits
nothing either, and gives the same result.  A scan whose number is committed already changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import linkage, state, tracking
from larkspur.operators.steps import Steps
from larkspur.sources import pages
from larkspur.streaming.commit import Store

#: Positions of a source's results: a record's place in the scan is its source's rank times this, and its position.
PLACES = 1 << 40
PRICES = "id long, price long"


@dataclass
class Scan:
    status: str  #: ok, partial (a source is broken) or failed (none answered)
    health: DataFrame
    survivors: DataFrame | None = None
    uncertain: DataFrame | None = None
    classified: DataFrame | None = None
    counts: DataFrame | None = None  #: one row: total, new, updated, price_drops, disappeared
    committed: bool = False


def tracking_kind(at: str) -> str:
    return f"id long, first_seen {at}, last_seen {at}, misses long"


def run_scan(
    store: Store, number: int, readers: dict, enabled: list[str], estate: str, now: Column, viewed: DataFrame, favourites: DataFrame | None = None, keep: Column | None = None, position: str = "id", at: str = "timestamp", dry_run: bool = False
) -> Scan:
    """Run scan ``number`` of the enabled sources.

    Each reader gives records as ``linkage`` has them, without ord and source but with id (of the posting), price (long) and facts (how much
    is known); ``keep`` is the profile's criterion.  viewed and favourites: id.
    """
    spark = store.spark
    steps = Steps(spark, "scan")
    rows, health = pages.read_sources(spark, readers, enabled, position)
    if not pages.answered(health):
        return Scan("failed", health)
    broken = not health.where("health = 'broken'").isEmpty()
    rows = rows.withColumn("ord", F.col("ord.source_rank") * F.lit(PLACES) + F.col("ord.position"))
    found = steps.written(rows.where(keep) if keep is not None else rows)
    survivors, merges, scored = linkage.link(found, estate)
    final = linkage.final_keepers(merges.withColumn("group", F.lit(0)), "group")
    named = lambda c, n: found.select(F.col("ord").alias(c), F.col("id").alias(n))
    absorbed = final.join(named("removed", "absorbed"), "removed").join(named("keeper", "keeper_id"), "keeper").select("absorbed", F.col("keeper_id").alias("keeper"), F.lit(1).alias("seq"))
    members = steps.written(tracking.members_of(survivors.select("id"), absorbed).join(found.select("id", "price"), "id"))
    before, prices = store.read("tracking", tracking_kind(at)), store.read("prices", PRICES)
    classified = steps.written(tracking.classify(members, before, viewed, prices))
    gone = state.disappeared(before, members, "id", now).agg(F.count("*").alias("disappeared"))
    counts = classified.agg(F.count("*").alias("total"), F.count_if("is_new").alias("new"), F.count_if("is_updated").alias("updated"), F.count("drop_from").alias("price_drops"))
    counts = steps.written(counts.join(F.broadcast(gone)))  # a row each
    kept = state.prune(state.advance_tracking(before, members, "id", now), favourites if favourites is not None else before.limit(0), "id", now)
    priced = state.upsert(prices, members.where("price is not null").select("id", "price"), "id")
    committed = store.commit(number, {"tracking": kept, "prices": priced}, dry_run=dry_run)
    return Scan("partial" if broken else "ok", health, survivors, scored.where("band = 'uncertain'"), classified, counts, committed)
