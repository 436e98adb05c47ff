from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import normalize_name
from larkspur.operators import criteria, gallery, history, linkage, ranking, register, resolver, state
from larkspur.plans import catalog

T = dt.datetime(2024, 1, 1)


def log(spark, prices, key=1):
    return spark.createDataFrame([(key, T + dt.timedelta(hours=i), i, p) for i, p in enumerate(prices)], "item long, seen timestamp_ntz, id long, price long")


COLUMNS = ("item", "seen", "id", "price")


@pytest.mark.parametrize("prices, latest, previous, drop", [([20, 19], 19, 20, 20), ([20, 19, 19], 19, 20, 20), ([20, 19, 20], 20, 19, None), ([5], 5, None, None), ([7, 7], 7, None, None)])
def test_price_drops(spark, prices, latest, previous, drop):
    found = history.with_drop(history.previous_different(log(spark, prices), *COLUMNS), "price").first()
    assert (found.price, found.previous, found.drop_from) == (latest, previous, drop)
    assert history.latest(log(spark, prices), *COLUMNS).first().price == latest


def test_runs_collapse_repeats_and_a_rise_back_opens_a_new_one(spark):
    runs = history.price_runs(log(spark, [5, 5, 6, 5]), *COLUMNS)
    assert [(r.run, r.price, r.first_seen_at.hour, r.last_seen_at.hour) for r in runs.orderBy("run").collect()] == [(1, 5, 0, 1), (2, 6, 2, 2), (3, 5, 3, 3)]
    assert [(r.price_from, r.price_to) for r in history.price_changes(runs, "item", "price").orderBy("seen_at").collect()] == [(5, 6), (6, 5)]
    assert [r.held_until.hour for r in history.held_until(runs, "item").orderBy("run").collect()] == [2, 3, 3]


def test_as_of_equals_a_loop(spark):
    rng = random.Random(2)
    seen = [(k, T + dt.timedelta(hours=rng.randrange(50)), i, rng.randrange(9) or None) for i, k in enumerate(rng.choices(range(4), k=60))]
    asked = [(i, rng.randrange(5), T + dt.timedelta(hours=rng.randrange(60))) for i in range(40)]
    out = history.as_of(spark.createDataFrame(asked, "n long, item long, moment timestamp_ntz"), spark.createDataFrame(seen, "item long, seen timestamp_ntz, id long, price long"), "item", "moment", *COLUMNS[1:])
    for r in out.collect():
        before = [x for x in seen if x[0] == r.item and x[1] <= r.moment]
        assert r.as_of_price == (max(before, key=lambda x: (x[1], x[2]))[3] if before else None)


def test_missing_values_pass_criteria_and_fail_filters(spark):
    items = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, 10, "a"), (4, 11, "a"), (5, 5, "b")], "id long, size int, layout string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(criteria.apply_criteria(items, {"size": (5, 10)}, ["a"], "layout")) == [1, 2, 3]
    assert ids(criteria.apply_filter(items, {"size": (5, 10)}, {"layout": ["a"]})) == [3]
    assert ids(criteria.apply_filter(items, {"size": (None, None)}, {"layout": []})) == [1, 2, 3, 4, 5]
    places = spark.createDataFrame([(1, 7, None), (2, 7, 3)], "id long, region long, town long")
    assert ids(places.where(criteria.inside_place("town", 3, {"town": "town", "region": "region"}))) == [2]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("metres, tier, points", [(100, "gps", 35), (101, "gps", 34.95), (1499, "gps", -34.95), (1500, "gps", -35), (800, "gps", 0), (400, "street", 35), (5000, "part", -20), (15000, "town", 0), (5, "district", 0), (5, None, 0)])
def test_gps_points(spark, metres, tier, points):
    assert one(spark, linkage.gps_points(F.lit(metres), F.lit(tier).cast("string"))) == pytest.approx(points, abs=0.01)


@pytest.mark.parametrize("a, b, points", [(100, 100, 15), (100, 90, 0), (1000, 950, 7.5), (100, 80, -12.5), (100, 10, -25), (0, 10, 0), (None, 10, 0)])
def test_price_points(spark, a, b, points):
    assert one(spark, linkage.price_points(F.lit(a).cast("long"), F.lit(b).cast("long"))) == pytest.approx(points)


@pytest.mark.parametrize("a, b, points", [(50, 52, 10), (50, 53, 7.5), (50, 56, 0), (50, 61, -7.5), (50, 90, -15), (0, 50, 0), (None, 50, 0)])
def test_size_points(spark, a, b, points):
    assert one(spark, linkage.size_points(F.lit(a).cast("int"), F.lit(b).cast("int"))) == pytest.approx(points)


def test_bands_and_agreement(spark):
    band = lambda t, e, a: one(spark, linkage.band(F.lit(float(t)), F.lit(e), F.lit(a)))
    assert [band(55, True, True), band(55, True, False), band(30, True, True), band(29.9, True, True), band(90, False, True)] == ["match", "uncertain", "uncertain", "no_match", "no_match"]
    n = lambda x: F.lit(x).cast("int")
    agrees = lambda estate, la, lb, *v: one(spark, linkage.property_agrees(estate, F.lit(la).cast("string"), F.lit(lb).cast("string"), *map(n, v)))
    assert agrees("flat", "2+1", "2+1", 100, 95, 50, 56, None, None) and not agrees("flat", None, None, 100, 95, 50, 50, None, None)
    assert agrees("house", None, "2+1", 100, 95, None, None, 500, 460) and not agrees("house", "2+1", "3+1", 100, 95, 50, 50, 5, 5)
    assert agrees("land", None, None, 100, 95, None, None, 500, 460) and not agrees("land", None, None, 100, 80, None, None, 500, 500)
    assert one(spark, linkage.name_points(F.lit("street"), F.lit(True))) == -35 and one(spark, linkage.name_points(F.lit(None).cast("string"), F.lit(False))) == -8


def loop(pairs):
    gone = {}
    for i, j, keep_i in sorted(pairs):
        if j in gone or (i in gone and gone[i][1] < i):
            continue
        lost, keeper = (j, i) if keep_i else (i, j)
        gone[lost] = (keeper, i)
    return {k: v[0] for k, v in gone.items()}


def test_greedy_merge_equals_a_loop_and_is_not_transitive(spark):
    rng = random.Random(3)
    rows = [(g, i, j, rng.random() < 0.5) for g in range(60) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.4]
    found = {}
    for r in linkage.greedy_merge(spark.createDataFrame(rows, "g long, i long, j long, keep_i boolean"), "g").collect():
        found.setdefault(r.g, {})[r.removed] = r.keeper
    assert found == {g: m for g in range(60) if (m := loop([r[1:] for r in rows if r[0] == g]))}
    chain = linkage.greedy_merge(spark.createDataFrame([(0, 0, 1, True), (0, 1, 2, True)], "g long, i long, j long, keep_i boolean"), "g")
    assert {(r.removed, r.keeper) for r in chain.collect()} == {(1, 0)}
    kept = linkage.final_keepers(spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "g long, removed long, keeper long"), "g")
    assert {(r.removed, r.keeper) for r in kept.collect()} == {(1, 4), (2, 4), (3, 4)}


def test_greedy_merge_collects_no_group(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(0, i, j, rng.random() < 0.5) for i in range(300) for j in range(i + 1, 300) if rng.random() < 0.1]
    rows += [(1, i, i + 1, True) for i in range(12)]
    matches = spark.createDataFrame(rows, "g long, i long, j long, keep_i boolean")
    monkeypatch.setattr(linkage.F, "collect_list", None)
    found = {0: {}, 1: {}}
    for r in linkage.greedy_merge(matches, "g").collect():
        found[r.g][r.removed] = r.keeper
    assert found == {g: loop([r[1:] for r in rows if r[0] == g]) for g in found}


def test_hot_blocks_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_BLOCK", 7)
    rows = [(i, "ab"[i % 2], "x", 100, 50.0, 14.0) for i in range(60)]
    records = spark.createDataFrame(rows, "ord long, source string, layout string, price long, lat double, lon double")
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if (i + j) % 2)
    for pairs in (linkage.candidates(records, "layout"), linkage.nearby(records, 800.0)):
        assert sorted((r.a.ord, r.b.ord) for r in pairs.collect()) == want


def test_blocks_lose_no_pair(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.randrange(0, 400), rng.uniform(50, 50.2), rng.uniform(14, 14.2)) for i in range(150)]
    records = spark.createDataFrame(rows, "ord long, source string, layout string, price long, lat double, lon double")
    found = {(r.a.ord, r.b.ord) for r in linkage.candidates(records, "layout").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and a[3] and b[3] and abs(a[3] - b[3]) <= 0.1 * max(a[3], b[3])}
    assert want <= found and len(found) < 150 * 149 // 4
    assert {(r.a.ord, r.b.ord) for r in linkage.nearby(records, 1450.0).collect()} == near(rows, 1450)


def test_useful_pairs_are_all_found(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        names = [(rng.choice(["n1", "n2", "n3", "n4"]), rng.choice(linkage.TIERS[1:])) for _ in range(rng.randrange(3))]
        rows.append((i, rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice([None, 0, 100, 108, 125, 400]), rng.choice([50, 52, 70, None]), rng.choice([None, 50 + rng.random() / 5]), 14 + rng.random() / 5, rng.choice([*linkage.TIERS, None]), names))
    records = spark.createDataFrame(rows, "ord long, source string, layout string, price long, size int, lat double, lon double, tier string, names array<struct<name:string,tier:string>>")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    every = records.select(F.struct("*").alias("a")).crossJoin(records.select(F.struct("*").alias("b"))).where("a.ord < b.ord and a.source <> b.source")
    tiers = F.array(*(F.lit(t) for t in linkage.TIERS))
    place = lambda t: F.array_position(tiers, t)
    looser = F.element_at(tiers, F.greatest(place(a("tier")), place(b("tier"))).cast("int"))
    known = a("lat").isNotNull() & b("lat").isNotNull() & a("tier").isNotNull() & b("tier").isNotNull()
    gps = F.when(known, linkage.gps_points(linkage.metres(a("lat"), a("lon"), b("lat"), b("lon")), looser)).otherwise(0.0)
    shared = F.flatten(F.transform(a("names"), lambda x: F.transform(F.filter(b("names"), lambda y: y["name"] == x["name"]), lambda y: F.greatest(place(x["tier"]), place(y["tier"])))))
    tier = F.try_element_at(tiers, F.array_min(shared).cast("int"))
    name = F.when((F.size(a("names")) == 0) | (F.size(b("names")) == 0), 0.0).otherwise(linkage.name_points(tier, linkage.streets_disagree(a("names"), b("names"))))
    total = gps + name + linkage.layout_points(a("layout"), b("layout")) + linkage.price_points(a("price"), b("price")) + linkage.size_points(a("size"), b("size"))
    want = {tuple(r[:2]): r for r in every.select("a.ord", "b.ord", total.alias("t"), "a.price", "b.price").where("t >= 30").collect()}
    found = [(r.a.ord, r.b.ord) for r in linkage.useful(records).collect()]
    assert len(found) == len(set(found)) and want.keys() <= set(found) and len(found) < every.count()
    assert any(r[3] is None for r in want.values()) and any({r[3], r[4]} == {100, 125} for r in want.values())


def test_queries_score_pairs_without_prices_or_far_apart(spark, tmp_path):
    rows = [(1, "n", "b1", "t", 5, 100.0), (2, "n", "b2", "t", 5, None), (3, "n", "b3", "t", 5, 75.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.i, r.j): r.total for r in catalog.pair_score(spark, str(tmp_path)).collect()}
    assert found == {(1, 2): 55.0, (2, 3): 55.0, (1, 3): pytest.approx(36.25)}


def near(rows, reach):
    import math

    def away(a, b):
        h = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
        return round(2 * 6_371_000 * math.asin(math.sqrt(h)))

    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and away(a, b) <= reach}


def test_five_scans_count_misses(spark):
    tracking = spark.createDataFrame([], "item string, first_seen timestamp_ntz, last_seen timestamp_ntz, misses long")
    gone = []
    for day, seen in enumerate([["s", "f"], ["s"], ["s", "f"], ["s"], ["s"], ["s"]]):
        now = F.lit(T + dt.timedelta(days=day)).cast("timestamp_ntz")
        scan = spark.createDataFrame([(x,) for x in seen], "item string")
        gone.append([r.item for r in state.disappeared(tracking, scan, "item", now).collect()])
        tracking = spark.createDataFrame(state.advance_tracking(tracking, scan, "item", now).collect(), tracking.schema)
    assert gone == [[], [], [], [], [], ["f"]]
    assert {r.item: r.misses for r in tracking.collect()} == {"s": 0, "f": 3}


def test_prune_upsert_diff_and_health(spark):
    at = lambda d: T - dt.timedelta(days=d)
    tracking = spark.createDataFrame([("old", at(200), at(91)), ("favourite", at(200), at(91)), ("edge", at(200), at(90))], "item string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    kept = state.prune(tracking, spark.createDataFrame([("favourite",)], "item string"), "item", F.lit(T).cast("timestamp_ntz"))
    assert {r.item for r in kept.collect()} == {"favourite", "edge"}
    old, new = spark.createDataFrame([(1, "u1", 5), (2, "u2", 6)], "id long, url string, price long"), spark.createDataFrame([(2, "new", 7), (3, "u3", None)], "id long, url string, price long")
    assert sorted(map(tuple, state.upsert(old, new, "id", ("url",)).collect())) == [(1, "u1", 5), (2, "u2", 7), (3, "u3", None)]
    diff = {r.id: r.state for r in state.snapshot_diff(old, spark.createDataFrame([(2, 5), (3, 1)], "id long, price long"), "id", "price").collect()}
    assert diff == {1: "missing", 2: "dropped", 3: "new"}
    health = state.source_health(spark.createDataFrame([("a",), ("a",)], "s string"), spark.createDataFrame([("a",), ("b",), ("c",)], "s string"), "s", spark.createDataFrame([("c",)], "s string"))
    assert {(r.s, r.found, r.health) for r in health.collect()} == {("a", 2, "ok"), ("b", 0, "zero_results"), ("c", 0, "broken")}


def test_resolver_takes_one_unit_or_none(spark):
    rows = [("a", 1, 1, 10), ("a", 1, 1, 11), ("a", 1, 2, 20), ("b", 1, 1, 5), ("b", 1, 1, 5), ("c", 2, 3, 7), ("c", 1, 1, 1), ("c", 1, 1, 2), ("d", 1, 1, 1), ("d", 1, 1, 2)]
    found = {r.id: (r["pass"], r.kind_rank, r.code) for r in register.resolve(spark.createDataFrame(rows, "id string, pass int, kind_rank int, code long"), "id").collect()}
    assert found == {"a": (1, 2, 20), "b": (1, 1, 5), "c": (2, 3, 7)}


PLACES = "kind string, code long, name string, town_code long, town string, district_code long, district string, borough_code long, region_code long"


def small_register(spark):
    """A capital with two boroughs, and two towns in districts; names that are shared between them."""
    rows = [
        ("region", 1, "R1", None, None, None, None, None, 1), ("region", 2, "R2", None, None, None, None, None, 2),
        ("district", 5, "Domažlice", None, None, 5, "Domažlice", None, 2), ("district", 6, "Rudna", None, None, 6, "Rudna", None, 2),
        ("town", 10, "Praha", 10, "Praha", None, None, None, 1), ("town", 11, "Rudná", 11, "Rudná", 6, "Rudna", None, 2), ("town", 12, "Kdyně", 12, "Kdyně", 5, "Domažlice", None, 2),
        ("borough", 1, "Praha 1", 10, "Praha", None, None, 1, 1), ("borough", 7, "Praha 7", 10, "Praha", None, None, 7, 1),
        ("quarter", 71, "Holešovice", 10, "Praha", None, None, 7, 1),
        ("part", 100, "Holešovice", 10, "Praha", None, None, None, 1), ("part", 101, "Holešovice", 11, "Rudná", 6, "Rudna", None, 2), ("part", 102, "Kdyně", 12, "Kdyně", 5, "Domažlice", None, 2),
        ("street", 200, "Dlouhá", 10, "Praha", None, None, None, 1), ("street", 201, "Dlouhá", 12, "Kdyně", 5, "Domažlice", None, 2), ("street", 202, "Krátká", 12, "Kdyně", 5, "Domažlice", None, 2), ("street", 203, "Holešovice", 12, "Kdyně", 5, "Domažlice", None, 2),
    ]
    places = spark.createDataFrame(rows, PLACES).withColumn("name_norm", normalize_name(F.col("name"))).withColumn("town_norm", normalize_name(F.col("town"))).withColumn("district_norm", normalize_name(F.col("district")))
    pairs = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    return resolver.Register(places, pairs([(200, 71)], "street_code", "quarter_code"), pairs([(200, 100), (201, 102)], "street_code", "part_code"), pairs([(100, 71)], "part_code", "quarter_code"))


@pytest.mark.parametrize("names, district, want", [
    (["Holešovice", "Praha"], None, (1, None, 10, 7, 71, 100, None)),  # the town vouches, and the part lies in one quarter
    (["Holešovice"], None, None),  # three towns have it
    (["Holešovice"], "Rudná", (2, 6, 11, None, None, 101, None)),  # the district is named
    (["Kdyně"], None, (2, 5, 12, None, None, None, None)),  # the part named like its town is the town
    (["Krátká", "Nikde"], None, (2, 5, 12, None, None, None, 202)),  # a name of one town
    (["Krátká 12/3", "Nikde"], None, (2, 5, 12, None, None, None, 202)),
    (["Dlouhá", "Praha 7"], None, (1, None, 10, 7, 71, 100, 200)),  # the name without its number vouches for the town
    (["Nikde"], "Domažlice", (2, 5, None, None, None, None, None)),  # the district itself
    (["Dlouhá", "Praha"], None, (1, None, 10, 7, 71, 100, 200)),
    ([], None, None),
])
def test_names_are_one_place_or_none(spark, names, district, want):
    listings = spark.createDataFrame([(1, names, district)], "id long, names array<string>, district string")
    found = resolver.locate(listings, small_register(spark)).drop("pass").collect()
    assert [tuple(r)[1:] for r in found] == ([want] if want else [])


def test_each_name_counts_for_itself_and_the_first_wins(spark):
    listings = spark.createDataFrame([(1, ["Krátká", "Praha 1", "Kdyně"], None), (2, ["Krátká", "Rudná"], None)], "id long, names array<string>, district string")
    register_ = small_register(spark)
    found = {r.id: (r["pass"], r.kind, r.code) for r in resolver.resolved(resolver.readings(resolver.pool(listings, register_.places))).collect()}
    assert found == {1: (1, "street", 202), 2: (3, "street", 202)}


def test_one_place_of_a_name(spark):
    places = small_register(spark).places
    assert resolver.place_named(places, "town", "PRAHA") == ("town", 10)
    with pytest.raises(LookupError):
        resolver.place_named(places, "town", "Brno")
    with pytest.raises(ValueError):
        resolver.place_named(places, "street", "dlouha")


def test_tiers_and_names_of_a_pair(spark):
    names = lambda *own: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("tier")) for n, t in own)) if own else F.array().cast("array<struct<name:string,tier:string>>")
    a, b = names(("x", "street"), ("y", "part")), names(("y", "town"), ("x", "part"))
    assert one(spark, linkage.shared_tier(a, b)) == "part" and one(spark, linkage.shared_tier(a, names())) is None
    assert one(spark, linkage.streets_disagree(a, names(("z", "street")))) and not one(spark, linkage.streets_disagree(a, b))
    assert one(spark, linkage.looser_tier(F.lit("gps"), F.lit("quarter"))) == "quarter" and one(spark, linkage.looser_tier(F.lit("gps"), F.lit("district"))) is None
    assert one(spark, linkage.name_points(F.lit("street"), F.lit(False), F.lit(False))) == 0


def test_search_needs_two_letters(spark):
    places = spark.createDataFrame([("town", 1, "Praha", "praha"), ("street", 2, "Pražská", "prazska"), ("town", 3, "Prachatice", "prachatice")], "kind string, code long, name string, name_norm string")
    assert register.search(places, "p", {"town": 0, "street": 1}).count() == 0
    assert [r.code for r in register.search(places, "pra", {"town": 0, "street": 1}, 2).orderBy("rank").collect()] == [3, 1]


def test_score_skips_missing_facts(spark):
    i = lambda x: F.lit(x).cast("int")
    score = lambda **k: one(spark, ranking.match_score(i(k.get("price")), i(k.get("size")), i(k.get("land")), F.lit(k.get("layout")).cast("string"), F.lit(k.get("place")).cast("boolean"), k["w"], k.get("p", {})))
    assert score(price=300 * 50, size=50, w={"price_per_m2": 100}) == 100 and score(price=550 * 50, size=50, w={"price_per_m2": 100}) == 0
    assert score(price=1, w={"price_per_m2": 100}) == 0 and score(w={"place": 50}, place=True) == 50 and score(w={"place": 50}) == 0
    assert score(size=20, w={"size": 100}, p={"size": 40}) == 50 and score(size=90, w={"size": 100}, p={"size": 40}) == 100
    assert score(price=15, w={"price": 100}, p={"price": 10}) == 50 and score(price=25, w={"price": 5}, p={"price": 16}) == 2
    assert score(size=20, w={"size": 100}) == 0 and score(land=20, w={"land": 100}) == 0 and score(price=20, w={"price": 100}) == 0
    assert score(layout="2+1", place=True, w={"layout": 80, "place": 80}, p={"layouts": ["2+1"]}) == 160


def test_standing_equals_a_loop(spark):
    from math import floor
    from statistics import median

    rng = random.Random(6)
    rows = [(i, g, rng.choice([1, 2, 3, 5, 8, None])) for i, g in enumerate(rng.choices("abcdefg", k=60) + ["z"])]
    rows += [(100 + i, "hot", rng.randrange(500)) for i in range(400)] + [(600, None, 5), (601, None, 7), (602, "only", None), (603, "zero", 0), (604, "zero", 0)]
    found = ranking.standing(spark.createDataFrame(rows, "id long, g string, v int"), "g", "v").collect()
    assert sorted(r.id for r in found) == sorted(r[0] for r in rows)
    for r in found:
        others = [v for i, g, v in rows if g == r.g and i != r.id and v is not None] if r.v is not None else []
        assert r.others == len(others)
        assert r.middle == (median(others) if others else None)
        if others:
            assert r.below_percent == int(100 * sum(v < r.v for v in others) / len(others) + 0.5)
            assert r.above_percent == int(100 * sum(v > r.v for v in others) / len(others) + 0.5)
            assert r.is_lowest == all(r.v < v for v in others) and r.is_highest == all(r.v > v for v in others)
            assert (r.lowest, r.highest) == (min([r.v, *others]), max([r.v, *others]))
            assert r.middle_percent == (floor(100 * (r.v - r.middle) / r.middle + 0.5) if r.middle else None)
        else:
            assert (r.below_percent, r.lowest, r.middle_percent, r.is_lowest) == (None, None, None, False)


def test_order_puts_missing_values_last_either_way(spark):
    items = spark.createDataFrame([(1, None, T), (2, 5, T), (3, 9, T), (4, 5, T + dt.timedelta(1))], "id long, v int, at timestamp_ntz")
    assert [r.id for r in ranking.ordered(items, "v", "at", "id").collect()] == [3, 4, 2, 1]
    assert [r.id for r in ranking.ordered(items, "v", "at", "id", False).collect()] == [4, 2, 3, 1]


def test_rank_over_all_rows_equals_a_sort(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2, 3, None])) for i in rng.sample(range(1000), 300)]
    found = ranking.ranked_overall(spark.createDataFrame(rows, "id long, at int"), F.desc("at"), F.asc("id")).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r) for r in found] == [(*r, k + 1) for k, r in enumerate(want)]
    assert ranking.ranked_overall(spark.createDataFrame([], "id long"), F.asc("id")).collect() == []


def test_requested_pages_come_latest_request_first(spark):
    listings = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, 50)], "listing long, property long")
    photos = spark.createDataFrame([(1, 0)], "listing long, position int")
    asked = spark.createDataFrame([(10, 1), (20, 3), (30, 1), (40, 2), (50, 9)], "property long, requested_at long")
    reads = spark.createDataFrame([(k, 7 if k == 5 else None, 0) for k in range(1, 6)], "listing long, read_at int, attempts int")
    found = gallery.requested_pages(listings, photos, asked, reads).orderBy("rank").collect()
    assert [(r.listing, r["rank"]) for r in found] == [(2, 1), (4, 2), (1, 3), (3, 4)]


def test_listings_that_name_the_same_are_placed_together(spark):
    """Each listing has its row, but the work is done once a kind, in several tasks whatever the files, hot names included."""
    rows = [(k, ["Dlouhá", "Praha 7"] if k % 2 else ["Holešovice"], None if k % 2 else "Rudná") for k in range(40)] + [(40, ["Nikde"], None), (41, None, "Domažlice")]
    listings = spark.createDataFrame(rows, "id long, names array<string>, district string").coalesce(1)
    register_ = small_register(spark)
    kinds, members = resolver.kinds_of(listings)
    assert kinds.count() == 4 and members.count() == 42
    found = {r.id: (r["pass"], r.town_code, r.street_code) for r in resolver.locate(listings, register_).collect()}
    assert {k for k in found if k < 40} == set(range(40)) and 40 not in found and all(found[k] == ((1, 10, 200) if k % 2 else (2, 11, None)) for k in range(40))
    assert resolver.pool(listings, register_.places.coalesce(1)).rdd.getNumPartitions() > 1


def test_a_hot_name_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(resolver, "HOT_NAME", 3)
    listings = spark.createDataFrame([(k, ["Dlouhá"], None) for k in range(20)], "id long, names array<string>, district string")
    assert sorted((r.id, r.code) for r in resolver.pool(listings, small_register(spark).places).collect()) == sorted((k, c) for k in range(20) for c in (200, 201))
