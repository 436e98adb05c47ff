"""Linkage as a whole against a plain loop over all pairs, and the fold's rounds on chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import linkage

KIND = "ord long, source string, lat double, lon double, tier string, names array<struct<name:string,tier:string>>, has_names boolean, layout string, price long, size int, land int, facts int, home string"


def in_turn(matches, n):
    """{removed: keeper} in the order of removal, by the plain loop; matches {(i, j): keep_i}."""
    removed = {}
    for i in range(n):
        if i in removed:
            continue
        for j in range(i + 1, n):
            if j in removed or (i, j) not in matches:
                continue
            if matches[i, j]:
                removed[j] = i
            else:
                removed[i] = j
    return removed


def folded(spark, matches):
    rows = [("g", i, j, k) for (i, j), k in matches.items()]
    return linkage.greedy_merge(spark.createDataFrame(rows, "group string, i long, j long, keep_i boolean"), "group")


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    n = 40
    matches = {(i, j): rng.random() < 0.7 for i in range(n) for j in range(i + 1, n) if rng.random() < (0.15, 0.05, 0.03, 0.5)[seed]}
    matches |= {(i, i + 1): True for i in range(n - 1)} if seed == 1 else {}
    rows = folded(spark, matches).collect()
    want = in_turn(matches, n)
    assert {r.removed: r.keeper for r in rows} == want
    assert [r.removed for r in sorted(rows, key=lambda r: tuple(r.seq))] == list(want)


def test_rounds_on_a_chain_are_as_many_as_its_length_has_bits(spark):
    jobs = []
    for n in (25, 200):
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        rows = folded(spark, {(i, i + 1): True for i in range(n)}).collect()
        assert {r.removed: r.keeper for r in rows} == {j: j - 1 for j in range(1, n + 1, 2)}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] - jobs[0] <= 3 * 12  # three more steps of doubling, each a few jobs


def made(rng, n):
    rows = []
    for k in range(n):
        at = (50 + rng.choice([0, 0.001, 0.02, 0.5]) * rng.random(), 14.0 + 0.002 * rng.random())
        names = [(x, t) for x, t in (("Dlouhá", "street"), ("Krátká", "street"), ("Karlín", "part"), ("Praha", "town")) if rng.random() < 0.4]
        placed = rng.random() < 0.8
        rows.append((k, rng.choice("abc"), at[0] if placed else None, at[1] if placed else None, rng.choice(linkage.TIERS) if placed else None, names, bool(names) or rng.random() < 0.2, rng.choice(["1+1", "2+kk", None]),
                     rng.choice([None, 10_000, 10_300, 11_000, 15_000]), rng.choice([None, 40, 41, 45, 47]), None, rng.randrange(4), "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_linkage_equals_the_loop_over_all_pairs(spark, seed):
    rows = made(random.Random(seed), 90)
    records = spark.createDataFrame(rows, KIND)
    every = records.select(F.struct("*").alias("a")).crossJoin(records.select(F.struct("*").alias("b"))).where("a.ord < b.ord and a.source <> b.source")
    scored = {(r.i, r.j): r for r in linkage.score(every, "flat").where("band <> 'no_match'").collect()}
    matches = {k: rows[k[0]][11] >= rows[k[1]][11] for k, r in scored.items() if r.band == "match"}
    removed = in_turn(matches, len(rows))
    assert len(removed) > 3
    left, merged, found = linkage.link(records, "flat")
    assert {(r.i, r.j): (r.band, pytest.approx(r.total)) for r in found.collect()} == {k: (r.band, r.total) for k, r in scored.items()}
    assert {r.removed: r.keeper for r in merged.collect()} == removed
    sources = {}
    for i in removed:
        keeper = removed[i]
        while keeper in removed:
            keeper = removed[keeper]
        if rows[i][1] != rows[keeper][1] and rows[i][1] not in sources.setdefault(keeper, []):
            sources[keeper].append(rows[i][1])
    out = left.orderBy("ord").collect()
    assert [r.ord for r in out] == [k for k in range(len(rows)) if k not in removed]
    assert all(r.sources == sources.get(r.ord, []) and r.home == "x" for r in out)


def test_nothing_to_link(spark):
    left, merged, found = linkage.link(spark.createDataFrame(made(random.Random(1), 1), KIND), "flat")
    assert left.count() == 1 and merged.count() == found.count() == 0


def test_few_pairs_beyond_the_scored_ones(spark):
    """Of 2,000 records that are spread out, few pairs miss the score."""
    rng = random.Random(3)
    rows = [(k, rng.choice("abcd"), 49 + 2 * rng.random(), 13 + 4 * rng.random(), rng.choice(linkage.TIERS), [(f"s{rng.randrange(300)}", "street"), (f"p{rng.randrange(40)}", "part"), (f"t{rng.randrange(9)}", "town")], True,
             rng.choice(["1+1", "2+kk", "3+1"]), rng.randrange(8_000, 40_000), rng.randrange(20, 120), None, 1, "x") for k in range(2000)]
    pairs = linkage.useful(spark.createDataFrame(rows, KIND))
    scored = linkage.score(pairs, "flat").where("total >= 30").count()
    assert scored > 100 and pairs.count() < 10 * scored


def test_tiers_of_names_and_places(spark):
    places = spark.createDataFrame([("street", "dlouha", "praha"), ("part", "dlouha", "praha"), ("street", "dlouha", "brno"), ("district", "praha", None), ("town", "praha", "praha")], "kind string, name_norm string, town_norm string")
    listings = spark.createDataFrame([(1, ["dlouha", "praha"], "praha"), (2, ["dlouha"], "brno"), (3, ["dlouha", "nikde"], None), (4, ["nikde"], "praha")], "id long, names array<string>, town_norm string")
    got = {r.id: [(n.name, n.tier) for n in r.names] for r in linkage.name_tiers(listings, places).collect()}
    assert got == {1: [("dlouha", "part"), ("praha", "town")], 2: [("dlouha", "street")], 3: [("dlouha", "part")]}
    one = lambda **c: spark.range(1).select(linkage.place_evidence(*(F.lit(c.get(k)).cast(t) for k, t in (("lat", "double"), ("lon", "double"), ("ulat", "double"), ("ulon", "double"), ("kind", "string")))).alias("p")).first().p
    assert tuple(one(lat=1.0, lon=2.0, kind="street", ulat=5.0, ulon=6.0)) == (1.0, 2.0, "gps")
    assert tuple(one(lat=1.0, kind="street", ulat=5.0, ulon=6.0)) == (5.0, 6.0, "street") and one() is None
    f = lambda a, b: spark.range(1).select(linkage.richer_first(F.lit(a), F.lit(b)).alias("x")).first().x
    assert f(2, 2) and f(3, 2) and not f(1, 2)
    row = spark.range(1).select(linkage.evidence_json(F.lit(61.5), F.lit("match"), {"gps": (F.lit(35.0), F.lit("80 m")), "price": (F.lit(0.0), F.lit(None).cast("string"))}).alias("j")).first().j
    assert row == '{"total":61.5,"band":"match","factors":[{"name":"gps","contribution":35.0,"evidence":"80 m"},{"name":"price","contribution":0.0}]}'


def every_pair(records):
    return records.select(F.struct("*").alias("a")).crossJoin(records.select(F.struct("*").alias("b"))).where("a.ord < b.ord and a.source <> b.source")


@pytest.mark.parametrize("small_block", [3, 1000])
def test_useful_pairs_of_large_and_small_layouts(spark, small_block):
    """Each pair comes from one block, also where layouts are large, and where only place and another name add up to the score."""
    at = lambda k, source, names: (k, source, 50.0, 14.0, "quarter", names, True, "2+kk", None, None, None, 1, "x")
    rows = made(random.Random(5), 90) + [at(90, "a", [("Karlín", "part")]), at(91, "b", [("Karlín", "part")])]
    records = spark.createDataFrame(rows, KIND)
    want = {(r.i, r.j) for r in linkage.score(every_pair(records), "flat").where("total >= 30").collect()}
    found = [(r.i, r.j) for r in linkage.useful(records, small_block=small_block).select("a.ord", "b.ord").toDF("i", "j").collect()]
    assert (90, 91) in want and len(found) == len(set(found)) and want <= set(found) and len(found) < 90 * 91 // 2


@pytest.mark.parametrize("estate", ["flat", "house", "land"])
def test_matches_come_from_their_own_blocks(spark, estate):
    rows = [(*r[:10], None if r[0] % 4 == 0 else 300 + r[0] % 3 * 25, *r[11:]) for r in made(random.Random(7), 90)]
    records = spark.createDataFrame(rows, KIND).coalesce(1)
    want = {(r.i, r.j) for r in linkage.score(every_pair(records), estate).where("band = 'match'").collect()}
    pairs = linkage.matching(records, estate)
    found = [(r.i, r.j) for r in linkage.score(pairs, estate).where("band = 'match'").collect()]
    assert want and len(found) == len(set(found)) and set(found) == want
    assert pairs.rdd.getNumPartitions() > 1  # records of one file are met in several tasks
