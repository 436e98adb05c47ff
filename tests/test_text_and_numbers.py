from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import geo, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "ad, code",
    [("2+kk", "2+kk"), (" 3 + 1 ", "3+1"), ("2+KK", "2+kk"), ("Garsoniéra", "1+kk"), ("garsonka", "1+kk"), ("atypický", "atypical"), ("0+1", None), ("2+2", None), ("10+1", None), ("byt 2+kk", None), ("", None), (None, None)],
)
def test_layouts(spark, ad, code):
    assert one(spark, text.layout_code(F.lit(ad).cast("string"))) == code


def test_numbers_in_texts(spark):
    ad = F.lit("Byt 3+1 120 m², pozemek 1 234 m2")
    assert one(spark, text.size_m2(ad)) == 120 and one(spark, text.land_m2(ad)) == 1234
    assert one(spark, text.size_m2(F.lit("bez plochy"))) is None and one(spark, text.size_m2(F.lit(None).cast("string"))) is None
    assert tuple(one(spark, text.house_numbers(F.lit("Ulice 12/3a")))) == ("12", "3a")
    assert tuple(one(spark, text.house_numbers(F.lit("Ulice 12/12")))) == ("12", None)
    assert tuple(one(spark, text.house_numbers(F.lit("Ulice")))) == (None, None)


def test_names(spark):
    assert one(spark, text.normalize_name(F.lit("  Nad  Štolou  "))) == "nad stolou"
    assert one(spark, text.slug(F.lit("Hlavní město Praha"))) == "hlavni-mesto-praha"
    assert one(spark, text.candidate_names(F.array(F.lit("Dlouhá 12/3"), F.lit("Praha 7"), F.lit("praha 7")))) == ["dlouha 12/3", "dlouha", "praha 7", "praha"]
    parts = one(spark, text.split_address(F.lit("Kdyně - Brůdek, okres Domažlice, ,")))
    assert parts.names == ["Kdyně", "Brůdek"] and parts.district == "Domažlice"
    parts = one(spark, text.split_address(F.lit("Aš, okres Cheb, Aš, okres Plzeň")))
    assert parts.names == ["Aš"] and parts.district == "Plzeň"
    assert one(spark, text.candidate_names(F.array(F.lit("Ulice 5 Praha")))) == ["ulice 5 praha", "ulice praha"]
    assert one(spark, text.display_place(F.lit("A"), F.lit(None).cast("string"), F.lit("A"), F.lit("B"), F.lit("C"))) == "A, B"
    assert one(spark, text.display_place(F.lit(None).cast("string"))) is None
    assert one(spark, text.capitalized(F.lit(" prodej  bytu"))) == "Prodej bytu"


def test_built_in_normalisation_equals_the_exact_one(spark):
    names = ["Český Krumlov", "ŽĎÁR nad Sázavou", "Übersee", "Frýdek Místek", "plain", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_name(F.col("n")).alias("a"), text.normalize_name_exact("n").alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_rounding(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.5, -1.5, 0.5, 1.5, 2.5, 2.4)], "x double").select(numbers.half_up(F.col("x")).alias("up"), numbers.half_even(F.col("x")).alias("even")).collect()
    assert [r.up for r in rows] == [-2, -1, 1, 2, 3, 2] and [r.even for r in rows] == [-2, -2, 0, 2, 2, 2]
    assert one(spark, numbers.clamp(F.lit(None).cast("double"), 0, 1)) is None and one(spark, numbers.clamp(F.lit(7.0), 0, 1)) == 1
    assert one(spark, numbers.price_per_m2(F.lit(10), F.lit(0))) is None


def test_distances_and_cells(spark):
    points = [(50.0755, 14.4378), (49.1951, 16.6068), (50.0755, 14.4378), (-0.001, -0.001)]
    rng = random.Random(1)
    points += [(rng.uniform(48, 51), rng.uniform(12, 18)) for _ in range(20)]
    rows = spark.createDataFrame([(*a, *b) for a, b in zip(points, points[1:])], "a double, b double, c double, d double")
    got = rows.select("*", geo.metres(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"), geo.cell(F.col("a"), F.col("b")).alias("cell")).collect()
    assert got[0].m == 184332 and tuple(got[3].cell) == (-1, -1)
    for r in got:
        h = math.sin(math.radians(r.c - r.a) / 2) ** 2 + math.cos(math.radians(r.a)) * math.cos(math.radians(r.c)) * math.sin(math.radians(r.d - r.b) / 2) ** 2
        assert r.m == round(2 * 6_371_000 * math.asin(math.sqrt(h)))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aBč ,-– ", max_size=12), max_size=6))
def test_addresses_lose_no_letter(spark, parts):
    whole = ",".join(parts)
    found = one(spark, text.split_address(F.lit(whole)))
    keep = lambda s: "".join(c for c in s if c in "aBč")
    assert len(set(found.names)) == len(found.names)
    rest = keep(whole)
    for name in map(keep, found.names):  # names in order; what is left out is a repetition
        assert name in rest
        rest = rest[rest.index(name) + len(name) :]
