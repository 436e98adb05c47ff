"""The register's exchange file: territorial units as nested XML, read in splits.

Elements of the eight kinds stand in containers of the same name and can be told from them by their id.  A file is cut behind each
closing tag of the prefix, which no element has inside it, so that a task reads any part of a file and no value holds more than an
element (and what stands before it).  Fields are then parsed by name, whatever their prefixes.

Defined results: an element without a code, name or point where its kind has one is an error that names it (``strict``), or comes with
nulls; elements without an id are containers and give no row; elements that stand twice give two rows; an empty file gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import projection

# The format's names of the kinds, and of the parents that each kind names by code.
KINDS = {
    "Vusc": (),
    "Okres": ("Vusc",),
    "Orp": ("Vusc",),
    "Pou": ("Orp",),
    "Obec": ("Okres", "Pou"),
    "Mop": ("Obec",),
    "Momc": ("Obec", "Mop"),
    "CastObce": ("Obec",),
}
#: Kinds that are links between others and have neither name nor point here.
LINKS = ("Orp", "Pou")
PARENTS = tuple(dict.fromkeys(p for parents in KINDS.values() for p in parents))


def elements(spark: SparkSession, path: str, prefix: str = "vf") -> DataFrame:
    """kind, id and body (the XML inside) of each element of a file or folder of files."""
    pieces = spark.read.option("lineSep", f"</{prefix}:").text(path)
    opening = rf"(?s)^.*<{prefix}:({'|'.join(KINDS)})\s([^>]*)>(.*)$"  # the last one before the closing tag
    part = lambda n: F.regexp_extract("value", opening, n)
    found = pieces.where(F.col("value").rlike(opening)).select(part(1).alias("kind"), F.regexp_extract(part(2), r'\bid="([^"]*)"', 1).alias("id"), part(2).alias("head"), part(3).alias("body"))
    return found.where(F.col("id") != "").where(~F.endswith("head", F.lit("/"))).drop("head")


def _needed(value: Column, wanted: Column, what: str, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(wanted & value.isNull(), F.raise_error(F.format_string(f"%s %s has no {what}", "kind", "id"))).otherwise(value)


def units(found: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each element: kind, id, code, name, the codes of its parents (named by their kind), and lat and lon.

    Of several points the first one counts.
    """
    schema = f"Kod long, Nazev string, {', '.join(f'{p} struct<Kod:long>' for p in PARENTS)}"
    parsed = found.withColumn("e", F.from_xml(F.concat(F.lit("<e>"), "body", F.lit("</e>")), schema, {"ignoreNamespace": "true"}))
    point = F.split(F.trim(F.regexp_extract("body", r"<(?:\w+:)?pos\b[^>]*>([^<]*)<", 1)), r"\s+")
    at = lambda n: F.try_element_at(point, F.lit(n)).try_cast("double")
    parsed = parsed.withColumn("at", projection.wgs84(-at(1), -at(2)))
    whole = ~F.col("kind").isin(*LINKS)
    return parsed.select(
        "kind",
        "id",
        _needed(F.col("e.Kod"), F.lit(True), "code", strict).alias("code"),
        _needed(F.nullif(F.col("e.Nazev"), F.lit("")), whole, "name", strict).alias("name"),
        *(F.col(f"e.{p}.Kod").alias(p) for p in PARENTS),
        _needed(F.round("at.lat", 6), whole, "point", strict).alias("lat"),
        F.round("at.lon", 6).alias("lon"),
    )


def tables(found: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """The eight tables by kind: code, then name, its parents' codes, lat and lon; links without name and point.

    A town (Obec) has its region (Vusc) too, by its district or, without one, by its office's authority.
    """
    rows = units(found, strict)
    out = {}
    for kind, parents in KINDS.items():
        own = rows.where(F.col("kind") == kind)
        out[kind] = own.select("code", *(() if kind in LINKS else ("name",)), *parents, *(() if kind in LINKS else ("lat", "lon")))
    by_district = out["Okres"].select(F.col("code").alias("Okres"), F.col("Vusc").alias("_district"))
    by_office = out["Pou"].select(F.col("code").alias("Pou"), F.col("Orp").alias("_orp")).join(out["Orp"].select(F.col("code").alias("_orp"), F.col("Vusc").alias("_office")), "_orp", "left").drop("_orp")
    towns = out["Obec"].join(by_district, "Okres", "left").join(by_office, "Pou", "left")
    region = F.when(F.col("Okres").isNotNull(), F.col("_district")).otherwise(F.col("_office"))
    if strict:
        region = F.when(region.isNull(), F.raise_error(F.format_string("town %s reaches no region", "code"))).otherwise(region)
    out["Obec"] = towns.select("code", "name", "Okres", "Pou", region.alias("Vusc"), "lat", "lon")
    return out
