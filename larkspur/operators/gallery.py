"""Galleries: which photos there are of each flat, what is still to be fetched, and what a detail page changes.

photos: listing, position (from 0), url, file, attempts; reads: listing, read_at, attempts; requests: property, requested_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ranking import budget_per_group, ranked_overall

# Photos of a gallery, and attempts to fetch one.
MOST_PHOTOS, MOST_ATTEMPTS = 20, 3


def truncated(urls: DataFrame, listing: str = "listing", photos: str = "urls") -> DataFrame:
    """listing, position and url of the first photos of each array."""
    return urls.select(listing, F.posexplode(F.slice(photos, 1, MOST_PHOTOS)).alias("position", "url"))


def gallery_listings(listings: DataFrame, photos: DataFrame) -> DataFrame:
    """property and the listing with most photos, the least id among equals (listings: listing, property and others)."""
    counted = listings.join(photos.groupBy("listing").agg(F.count("*").alias("_n")), "listing", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return budget_per_group(counted, "property", 1, F.desc("_n"), F.asc("listing")).drop("rank", "_n")


def pending(file: Column, attempts: Column) -> Column:
    return file.isNull() & (attempts < MOST_ATTEMPTS)


def recorded_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """Photos with those of listings that had none; a gallery once recorded stays as it is."""
    fresh = new.where(F.col("position") < MOST_PHOTOS).join(old.select("listing").distinct(), "listing", "left_anti")
    return old.unionByName(fresh.select("listing", "position", "url", F.lit(None).cast(old.schema["file"].dataType).alias("file"), F.lit(0).cast(old.schema["attempts"].dataType).alias("attempts")))


def replaced(old: DataFrame, pages: DataFrame) -> DataFrame:
    """Photos after detail pages were read (listing, position, url): each page's own, files and attempts carried over by url from the
    last old row of that url to the first new one; listings whose page lists none keep theirs."""
    nth = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy("listing", "url").orderBy("position")))
    last = old.groupBy("listing", "url").agg(F.max_by(F.struct("file", "attempts"), "position").alias("_old")).withColumn("_k", F.lit(1))
    own = nth(pages.where(F.col("position") < MOST_PHOTOS)).join(last, ["listing", "url", "_k"], "left")
    fresh = own.select("listing", "position", "url", F.col("_old.file").alias("file"), F.coalesce("_old.attempts", F.lit(0)).cast(old.schema["attempts"].dataType).alias("attempts"))
    return old.join(pages.select("listing").distinct(), "listing", "left_anti").select(*fresh.columns).unionByName(fresh)


def after_failures(photos: DataFrame, failures: DataFrame) -> DataFrame:
    """Photos with attempts counted: failures has listing, position, give_up; to give up sets the most at once."""
    lost = failures.groupBy("listing", "position").agg(F.count_if(~F.col("give_up")).alias("_n"), F.max("give_up").alias("_gone"))
    both = photos.join(lost, ["listing", "position"], "left")
    counted = F.when(F.coalesce("_gone", F.lit(False)), F.greatest(F.lit(MOST_ATTEMPTS), F.col("attempts"))).otherwise(F.col("attempts") + F.coalesce("_n", F.lit(0)))
    return both.select("listing", "position", "url", "file", counted.cast(photos.schema["attempts"].dataType).alias("attempts"))


def main_photos(listings: DataFrame, photos: DataFrame, requests: DataFrame) -> DataFrame:
    """The first photo still to be fetched of each property whose whole gallery nobody asked for."""
    shown = gallery_listings(listings, photos).join(requests.select("property"), "property", "left_anti")
    return photos.where((F.col("position") == 0) & pending(F.col("file"), F.col("attempts"))).join(shown, "listing").select("property", "listing", "position", "url")


def requested_photos(listings: DataFrame, photos: DataFrame, requests: DataFrame) -> DataFrame:
    """All photos still to be fetched of the galleries asked for; rank is their order within a request, the latest of which come first."""
    shown = gallery_listings(listings, photos).join(requests, "property")
    rows = photos.where(pending(F.col("file"), F.col("attempts"))).join(shown, "listing")
    rank = F.row_number().over(Window.partitionBy("property", "requested_at").orderBy("listing", "position"))
    return rows.select("property", "listing", "position", "url", "requested_at", rank.cast("long").alias("rank"))


def requested_pages(listings: DataFrame, photos: DataFrame, requests: DataFrame, reads: DataFrame) -> DataFrame:
    """Unread detail pages of the galleries asked for; rank is their order over all requests, the latest first, then by listing."""
    unread = reads.where(F.col("read_at").isNull() & (F.col("attempts") < MOST_ATTEMPTS)).select("listing")
    rows = gallery_listings(listings, photos).join(requests, "property").join(unread, "listing")
    return ranked_overall(rows.select("property", "listing", "requested_at"), F.desc("requested_at"), F.asc("listing"))


def status(n_photos: Column, stored: Column, waiting: Column, reading: Column) -> Column:
    return F.when(reading, "downloading").when(n_photos == 0, "none").when(waiting > 0, "downloading").when(stored > 0, "stored").otherwise("failed")


def galleries(listings: DataFrame, photos: DataFrame, requests: DataFrame, reads: DataFrame) -> DataFrame:
    """property, listing, requested, n_photos, stored, waiting and status; left joins to distinct keys stand for the tests of existence."""
    flag = lambda df, key, name: df.select(key, F.lit(True).alias(name)).distinct()
    unread = reads.where(F.col("read_at").isNull() & (F.col("attempts") < MOST_ATTEMPTS))
    shown = gallery_listings(listings, photos).select("property", "listing")
    shown = shown.join(flag(requests, "property", "_asked"), "property", "left").join(flag(unread, "listing", "_unread"), "listing", "left")
    asked = F.coalesce("_asked", F.lit(False))
    own = shown.join(photos, "listing", "left")
    to_come = pending(F.col("file"), F.col("attempts")) & F.col("url").isNotNull() & (asked | (F.col("position") == 0))
    found = own.groupBy("property", "listing").agg(F.max(asked).alias("requested"), F.max(F.coalesce("_unread", F.lit(False))).alias("_page"), F.count("position").alias("n_photos"), F.count("file").alias("stored"), F.count_if(to_come).alias("waiting"))
    return found.select("property", "listing", "requested", "n_photos", "stored", "waiting", status(F.col("n_photos"), F.col("stored"), F.col("waiting"), F.col("_page")).alias("status"))


def orphan_files(stored: DataFrame, photos: DataFrame) -> DataFrame:
    """Stored files that no photo refers to."""
    return stored.select("file").distinct().join(photos.where("file is not null").select("file"), "file", "left_anti")
