"""Rows from pages and payloads: cards with data attributes, galleries, embedded caches with references, and harvested names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cards(pages: DataFrame, html: str, tag: str, attributes: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each element of a tag, in order: place, text (without markup) and its data attributes, null where it has none."""
    every = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)(<{tag}\b[^>]*>.*?</{tag}>)"), F.lit(1))
    rows = pages.select(*keep, F.posexplode(every).alias("place", "card"))
    head = F.regexp_extract("card", rf"^<{tag}\b[^>]*>", 0)
    value = lambda a: F.nullif(F.regexp_extract(head, rf'\s{a}="([^"]*)"', 1), F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace("card", r"<[^>]*>", " "), r"\s+", " "))
    return rows.select(*keep, "place", text.alias("text"), *(value(a).alias(a) for a in attributes))


def gallery(html: Column, pattern: str) -> Column:
    """Addresses that a pattern finds, in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda u: u != ""))


def cache_entries(payloads: DataFrame, json: str, *keep: str) -> DataFrame:
    """Entries of a flat cache (an object of objects) as rows: key and its own fields as JSON texts."""
    return payloads.select(*keep, F.explode(F.from_json(json, "map<string,string>")).alias("key", "value")).select(*keep, "key", F.from_json("value", "map<string,string>").alias("fields"))


def followed(entries: DataFrame, field: str, *keep: str) -> DataFrame:
    """Entries with the fields of the entry that ``field`` refers to (by its __ref) as ``target``: an equi-join of the entries with themselves."""
    ref = F.get_json_object(F.col("fields")[field], "$.__ref")
    targets = entries.select(*keep, F.col("key").alias("_ref"), F.col("fields").alias("target"))
    return entries.withColumn("_ref", ref).join(targets, [*keep, "_ref"], "left").drop("_ref")


def agreed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and value where all copies agree; ``conflict`` says where they don't."""
    return rows.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias(value), (F.min(value) != F.max(value)).alias("conflict"))


def matched_names(official: DataFrame, portal: DataFrame, name: str = "name_norm") -> DataFrame:
    """name_norm, code, portal_id and problem: null where one official unit meets one portal name, else ambiguous, missing (no portal
    name) or unknown (no official unit)."""
    a = official.groupBy(name).agg(F.min("code").alias("code"), F.count("*").alias("_a"))
    b = portal.groupBy(name).agg(F.min("portal_id").alias("portal_id"), F.count("*").alias("_b"))
    both = a.join(b, name, "full")
    problem = F.when((F.col("_a") > 1) | (F.col("_b") > 1), "ambiguous").when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unknown")
    return both.select(name, "code", "portal_id", problem.alias("problem"))


def street_centres(addresses: DataFrame) -> DataFrame:
    """street, y and x: the mean of the located addresses of each street (in the plane, before any projection); others are left out."""
    both = addresses.where("street is not null and x is not null and y is not null")
    return both.groupBy("street").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))


def overlaps(addresses: DataFrame, a: str, b: str, located: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of units that share an address; of streets those in ``located`` alone."""
    pairs = addresses.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    return pairs if located is None else pairs.join(located.select(F.col("street").alias(a)), a, "left_semi")


def verified(counts: dict[str, tuple[DataFrame, int, int]], parents: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """rule, found and ok: row counts within ranges, and rows whose parent is not there (none is ok)."""
    out = None
    rows = [(n, df.agg(F.count("*").alias("found")), low, high) for n, (df, low, high) in counts.items()]
    rows += [(n, child.where(F.col(key).isNotNull()).join(parent.select(F.col(code).alias(key)), key, "left_anti").agg(F.count("*").alias("found")), 0, 0) for n, (child, key, parent, code) in parents.items()]
    for name, df, low, high in rows:
        one = df.select(F.lit(name).alias("rule"), "found", F.col("found").between(low, high).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def headed_items(pages: DataFrame, html: str, heading: str, item: str, *keep: str) -> DataFrame:
    """Items of a form under their headings, in order: place, heading and the groups of ``item`` (g1, g2 ...).

    heading has one group, item as many as it needs; items before the first heading have none.  A window is within one page.
    """
    n = len(re.findall(r"(?<!\\)\((?!\?)", item))
    token = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)((?:{_plain(heading)})|(?:{_plain(item)}))"), F.lit(1))
    rows = pages.withColumn("_page", F.monotonically_increasing_id()).select("_page", *keep, F.posexplode(token).alias("place", "_token"))
    rows = rows.withColumn("_heading", F.when(F.col("_token").rlike(heading), F.trim(F.regexp_extract("_token", heading, 1))))
    rows = rows.withColumn("heading", F.last("_heading", ignorenulls=True).over(Window.partitionBy("_page").orderBy("place")))
    groups = [F.regexp_extract("_token", item, k).alias(f"g{k}") for k in range(1, n + 1)]
    return rows.where(F.col("_heading").isNull()).select(*keep, "place", "heading", *groups)


def _plain(pattern: str) -> str:
    """A pattern whose groups catch nothing."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def script_pairs(pages: DataFrame, text: str, pair: str, *keep: str) -> DataFrame:
    """Pairs (g1, g2) that a pattern of two groups finds in script texts, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({_plain(pair)})"), F.lit(1))
    rows = pages.select(*keep, F.posexplode(found).alias("place", "_pair"))
    return rows.select(*keep, "place", F.regexp_extract("_pair", pair, 1).alias("g1"), F.regexp_extract("_pair", pair, 2).alias("g2"))


def parameter_index(units: DataFrame, **portals: DataFrame) -> DataFrame:
    """units (kind, code, name and more) with the parameter by which each portal names them, a column a portal.

    Portals have kind, name and id.  Each unit needs exactly one id of each portal, and an id names one unit of a kind: a unit without
    one, a name with several, or an id of several units is an error that names it.
    """
    out = units
    for portal, rows in portals.items():
        own = rows.select("kind", "name", "id").distinct()
        each = own.groupBy("kind", "name").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
        shared = own.groupBy("kind", "id").agg(F.count("*").alias("_names")).select(F.col("kind").alias("_kind"), F.col("id").alias("_of"), "_names")
        out = out.join(each, ["kind", "name"], "left")
        out = out.join(shared, (F.col("kind") == F.col("_kind")) & (F.col("_id") == F.col("_of")), "left").drop("_kind", "_of")
        wrong = F.when(F.col("_n").isNull(), "has no id").when(F.col("_n") > 1, "has several ids").when(F.col("_names") > 1, "shares its id")
        said = F.concat(F.lit(f"{portal}: "), "kind", F.lit(" "), "name", F.lit(" "), wrong)
        out = out.withColumn(portal, F.when(wrong.isNotNull(), F.raise_error(said)).otherwise(F.col("_id"))).drop("_n", "_id", "_names")
    return out
