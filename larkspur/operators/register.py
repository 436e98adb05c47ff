"""A place register: units of several kinds under each other, and answers that are one unit or nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of units from the finest.
KINDS = ("street", "part", "quarter", "borough", "town", "district", "region")
LADDER = ("street", "part", "quarter", "town")


def only(x: Column) -> Column:
    """Aggregate: the one distinct value, or null if there are none or several; one pass with partial sums."""
    return F.when(F.min(x) == F.max(x), F.max(x))


def hierarchy(*levels: DataFrame) -> DataFrame:
    """All levels as one table (kind, code, name, parent codes), by name; levels without a parent column have null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


def touching(bridge: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of units that share a member."""
    return bridge.select(a, b).distinct()


def touching_all(bridge: DataFrame, a: str, b: str, wanted: DataFrame) -> DataFrame:
    """Values of a that touch every value of b in wanted (relational division)."""
    n = wanted.select(b).distinct().agg(F.count("*").alias("_n"))
    return bridge.select(a, b).distinct().join(wanted.select(b).distinct(), b).groupBy(a).agg(F.count("*").alias("_m")).join(F.broadcast(n), F.col("_m") == F.col("_n")).select(a)


def search(places: DataFrame, prefix: str, kinds: dict[str, int], limit: int = 20, within: Column | None = None) -> DataFrame:
    """Places whose normalised name begins with a prefix of two letters or more, by rank of their kind, then name; with rank."""
    if len(prefix) < 2:
        return places.limit(0).withColumn("rank", F.lit(0).cast("long"))
    rank = F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    hits = places.where(F.col("name_norm").startswith(prefix) & (within if within is not None else F.lit(True))).withColumn("_kind", rank)
    order = ("_kind", "name_norm", "name", "code")
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long")).drop("_kind")


def resolve(candidates: DataFrame, id_: str) -> DataFrame:
    """One unit or nothing for each id.

    candidates: id, kind_rank, code and the pass (1 first) in which the row may be taken.  For each pass and kind, in that order, a unit
    is taken if it is the only one; the first such answer wins.  One group-by for the counts and one for the answer.
    """
    single = candidates.groupBy(id_, "pass", "kind_rank").agg(only(F.col("code")).alias("code")).where(F.col("code").isNotNull())
    return single.groupBy(id_).agg(F.min_by(F.struct("kind_rank", "code", "pass"), F.struct("pass", "kind_rank")).alias("_u")).select(id_, F.col("_u.kind_rank").alias("kind_rank"), F.col("_u.code").alias("code"), F.col("_u.pass").alias("pass"))


def refined(stored_rank: Column, stored_house: Column, new_rank: Column, new_house: Column) -> Column:
    """Whether a new location is more exact than the stored one: a finer unit, or as fine with a house number."""
    has = lambda h: h.isNull().cast("int")
    return F.struct(new_rank.alias("r"), has(new_house).alias("h")) < F.struct(stored_rank.alias("r"), has(stored_house).alias("h"))
