"""The nearest place of each point, exactly, for any number of both.

Places are put into a tree of cells: the box of all of them is cut into 4 by 4, and again each cell that holds more than ``LEAF`` places.
Points go down the tree together, a round a level, with the cells that can still hold their nearest place: a cell goes when the least
possible distance to its box is more than the distance to some place already known, the first one of another cell.  A join per
round meets a cell with its parts, of which there are 16 at most; points whose cells are all leaves leave the rounds, and meet
the few places of these at last.

Defined results: points without a position or with no place at all get nulls; places without one are left out; distances count to the
micrometre, and of equally near places the first in ``order`` is taken; rows of equal ids are each on their own; the date line is no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.geo import RADIUS, distance
from larkspur.operators.steps import Steps

#: Places that a leaf holds, parts of a cell along each axis, and levels after which a cell is a leaf whatever it holds.
LEAF, PARTS, LEVELS = 32, 4, 24
#: Cells of a level that may be broadcast.
FEW = 50_000


def _least(lat: Column, lon: Column) -> Column:
    """A distance that no place of the box (south, north, west, east) is nearer than."""
    apart = lambda at, low, high: F.greatest(F.lit(0.0), low - at, at - high)
    east = F.least(*(apart(lon + turn, F.col("west"), F.col("east")) for turn in (-360.0, 0.0, 360.0)))
    north = apart(lat, F.col("south"), F.col("north"))
    cos = F.least(F.cos(F.radians("south")), F.cos(F.radians("north")))
    half = lambda a: F.pow(F.sin(F.radians(F.least(a, F.lit(180.0))) / 2), 2)
    h = half(north) + F.cos(F.radians(lat)) * F.greatest(cos, F.lit(0.0)) * half(east)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (1 - 1e-9) - 1e-3


def tree(places: DataFrame, steps: Steps, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """Cells of each level (cell, parent, box, first place, whether it is a leaf), and the places with their leaf.

    places: lat, lon, key (a struct to order by, which ends in the place itself).
    """
    box = places.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    if box[0] is None:
        return [], None
    south, west, side = box[0], box[1], max(box[2] - box[0], box[3] - box[1], 1e-9) * (1 + 1e-9)
    open_, levels, done = places.withColumn("parent", F.lit("")), [], None
    for level in range(1, LEVELS + 1):
        side /= PARTS
        n = lambda c, low: F.floor((F.col(c) - low) / side).cast("string")  # noqa: B023, E731
        placed = open_.withColumn("cell", F.concat_ws(",", F.lit(level), n("lat", south), n("lon", west)))
        cells = placed.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("key").alias("first"))
        cells = steps.written(cells.withColumn("leaf", (F.col("n") <= leaf) | F.lit(level == LEVELS)))
        levels.append(cells)
        sorts = placed.join(_small(cells.select("cell", "leaf")), "cell")
        own = sorts.where("leaf").drop("parent", "leaf")
        done = own if done is None else done.unionByName(own)
        open_ = steps.written(sorts.where("not leaf").drop("parent", "leaf").withColumnRenamed("cell", "parent"))
        if open_.isEmpty():
            break
    return levels, done


def _small(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= FEW else cells


def nearest(points: DataFrame, places: DataFrame, id_: str, place_id: str, order: str | None = None, leaf: int = LEAF) -> DataFrame:
    """points with place (the id of the nearest) and metres; points and places have lat and lon, places come by ``order`` (their id)."""
    steps = Steps(points.sparkSession, "nearest")
    order = order or place_id
    located = places.where("lat is not null and lon is not null").select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.struct(F.col(order).alias("order"), F.col(place_id).alias("id")).alias("key"))
    # of places at one position the first alone can be an answer
    located = steps.written(located.groupBy("lat", "lon").agg(F.min("key").alias("key")))
    located = located.withColumn("key", F.struct("key.order", "key.id", "lat", "lon"))
    kept = steps.written(points.withColumn("_row", F.monotonically_increasing_id()))
    at = kept.where("lat is not null and lon is not null").select("_row", F.col("lat").cast("double").alias("y"), F.col("lon").cast("double").alias("x"))
    levels, leaves = tree(located, steps, leaf)
    if not levels:
        kind = places.schema[place_id].dataType
        return steps.last(kept.drop("_row").withColumn("place", F.lit(None).cast(kind)).withColumn("metres", F.lit(None).cast("double")))
    going = at.withColumn("cell", F.lit("")).withColumn("known", F.lit(float("inf")))
    ended = None
    for cells in levels:
        parts = cells.select(F.col("parent").alias("cell"), F.col("cell").alias("part"), "south", "north", "west", "east", "first", "leaf")
        met = going.join(_small(parts), "cell")
        met = met.select("_row", "y", "x", "known", "part", "leaf", _least(F.col("y"), F.col("x")).alias("least"), distance(F.col("y"), F.col("x"), F.col("first.lat"), F.col("first.lon")).alias("some"))
        all_ = met if ended is None else met.unionByName(ended.withColumn("some", F.col("known")))
        one = all_.groupBy("_row").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.least(F.min("some"), F.min("known")).alias("known"), F.collect_list(F.struct("part", "leaf", "least")).alias("parts"))
        left = steps.written(one.select("_row", "y", "x", "known", F.explode(F.filter("parts", lambda p: p["least"] <= F.col("known"))).alias("p")).select("_row", "y", "x", "known", "p.*"))
        ended = left.where("leaf")
        going = left.where("not leaf").select("_row", "y", "x", F.col("part").alias("cell"), "known")
    met = ended.select("_row", "y", "x", F.col("part").alias("cell")).join(leaves, "cell")
    best = met.groupBy("_row").agg(F.min(F.struct(F.round(distance(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")), 6).alias("metres"), F.col("key.order"), F.col("key.id"))).alias("best"))
    return steps.last(kept.join(best, "_row", "left").select(*(F.col(f"`{c}`") for c in points.columns), F.col("best.id").alias("place"), F.col("best.metres").alias("metres")))
