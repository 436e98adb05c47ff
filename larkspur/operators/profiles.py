"""Saved searches and what a reader sets: reading, exporting, which run, and the small computations of the forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.register import KINDS

# Fixed value: the least weight of a preference that counts.
LEAST_WEIGHT = 5


def read_profiles(profiles: DataFrame, facts: dict[str, DataFrame], lists: dict[str, DataFrame]) -> DataFrame:
    """Profiles with their facts (one row a profile_id, inner) and their lists as arrays, in the order of rank where there is one."""
    out = reduce(lambda done, df: done.join(df, "profile_id"), facts.values(), profiles)
    for name, df in lists.items():
        values = [c for c in df.columns if c not in ("profile_id", "rank")]
        item = F.struct(*(["rank"] if "rank" in df.columns else []), *values)
        own = F.array_sort(F.collect_list(item))
        value = (lambda x: x[values[0]]) if len(values) == 1 else (lambda x: F.struct(*(x[v].alias(v) for v in values)))
        nested = df.groupBy("profile_id").agg(F.transform(own, value).alias(name))
        out = out.join(nested, "profile_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def oldest_first(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("created_at", "profile_id")


def runnable(profiles: DataFrame, portals: DataFrame, only: list | None = None) -> DataFrame:
    """Profiles that are neither paused nor without a portal; of ``only`` if that is given."""
    rows = profiles.where("paused_at is null").join(portals.select("profile_id"), "profile_id", "left_semi")
    return rows.where(F.col("profile_id").isin(only)) if only is not None else rows


def scan_answered(health: DataFrame) -> bool:
    """Whether a scan may be written: some source is not broken."""
    return not health.where("health <> 'broken'").isEmpty()


def inside_where_widened(located: DataFrame, searched: tuple[str, int], area: tuple[str, int], inside: Column) -> DataFrame:
    """Rows inside the place; all of them where the area searched is the place itself."""
    return located if tuple(searched) == tuple(area) else located.where(F.coalesce(inside, F.lit(False)))


def exported(profiles: DataFrame) -> DataFrame:
    """One JSON text a profile."""
    return profiles.select(F.to_json(F.struct("*")).alias("profile"))


def imported(texts: DataFrame, schema: str, required: tuple[str, ...], text: str = "profile") -> DataFrame:
    """Profiles read back; texts that are unreadable, or lack a required field, are left out."""
    rows = texts.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("_p")).where("_p is not null")
    return rows.select("_p.*").where(reduce(Column.__and__, (F.col(c).isNotNull() for c in required), F.lit(True)))


def facet_values(items: DataFrame, value: str, vocabulary: DataFrame) -> DataFrame:
    """Values of a vocabulary (value, rank) that the items have, with their rank."""
    return vocabulary.join(items.select(F.col(value).alias("value")).where("value is not null").distinct(), "value", "left_semi")


def nearest_stop(value: Column, stops: list[float]) -> Column:
    """Index of the stop nearest to a value, the first among equals."""
    away = F.array(*(F.struct(F.abs(value - F.lit(s)).alias("d"), F.lit(i).alias("i")) for i, s in enumerate(stops)))
    return F.when(value.isNotNull(), F.array_min(away)["i"])


def kinds_inside(kind: Column) -> Column:
    """The finer kinds of place, the broadest first."""
    order = ["region", "district", "town", "borough", "quarter", "part", "street"]
    assert sorted(order) == sorted(KINDS)
    every = F.array(*(F.lit(k) for k in order))
    return F.slice(every, F.array_position(every, kind).cast("int") + 1, len(order))


def place_label(name: Column, kind: Column, code: Column, town: Column, district: Column) -> Column:
    """A place as it is read: its name (or kind and code), then its kind and what it lies in."""
    return F.concat(F.coalesce(name, F.concat_ws(" ", kind, code.cast("string"))), F.lit(" ("), F.concat_ws(", ", kind, town, district), F.lit(")"))


def in_preferred(location: dict[str, Column], preferred: Column) -> Column:
    """Whether a location (a code for each kind) lies in one of the preferred places (array of kind and code); false without a location."""
    one = lambda p: reduce(lambda done, k: done.when(p["kind"] == k, location[k] == p["code"]), list(location)[1:], F.when(p["kind"] == list(location)[0], location[list(location)[0]] == p["code"]))
    return F.coalesce(F.exists(preferred, lambda p: F.coalesce(one(p), F.lit(False))), F.lit(False))


def split_total(weights: Column, total: int = 100, least: int = LEAST_WEIGHT) -> Column:
    """Whole numbers that add up to total, in proportion to the weights (an array), equally if all are 0.

    Leftovers go to the largest remainders, the earlier among equals; what is then under the least is raised to it, in order, at
    the cost of the heaviest, the first among equals.
    """
    n, whole_sum = F.size(weights), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    exact = F.transform(weights, lambda x: F.when(whole_sum == 0, F.lit(float(total)) / n).otherwise(x * float(total) / whole_sum))
    parts = F.transform(exact, lambda x, i: F.struct((F.floor(x) - x).alias("r"), i.alias("i"), F.floor(x).cast("int").alias("w")))
    left = total - F.aggregate(parts, F.lit(0), lambda s, p: s + p["w"])
    ranked = F.transform(F.array_sort(parts), lambda p, k: F.struct(p["i"].alias("i"), (p["w"] + (k < left).cast("int")).alias("w")))
    shared = F.transform(F.array_sort(ranked), lambda p: p["w"])

    def lift(done, i):
        own = F.element_at(done, (i + 1).cast("int"))
        heaviest = F.array_position(done, F.array_max(done)) - 1
        raised = F.transform(done, lambda w, k: F.when(k == i, F.lit(least)).when(k == heaviest, w - (least - own)).otherwise(w))
        return F.when(own < least, raised).otherwise(done)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), shared, lift))


def nearest_examples(samples: DataFrame, score: str, targets: tuple[int, ...], order: str) -> DataFrame:
    """target and the sample whose score is nearest to it, the first among equals; of targets with one sample's score only the last stays."""
    rows = samples.select(F.struct(order, score, *[c for c in samples.columns if c not in (order, score)]).alias("s"))
    picked = rows.agg(*(F.min_by("s", F.struct(F.abs(F.col(f"s.{score}") - t), F.col(f"s.{order}"))).alias(f"t{k}") for k, t in enumerate(targets)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_n"), F.lit(t).alias("target"), F.col(f"t{k}").alias("s")) for k, t in enumerate(targets)))).alias("e")
    found = picked.select(each).select("e._n", "e.target", "e.s.*")
    last = found.groupBy(score).agg(F.max("_n").alias("_n"))
    return found.join(last, [score, "_n"]).drop("_n")


