"""Linkage of records of one thing across sources: pairwise, explainable, greedy in input order and not transitive.

Records have: ord, source, lat, lon, tier (how exact the place is), names (array of name and tier), has_names, layout, price, size,
land.  ``link`` does the whole of it: ``useful`` pairs, their scores, the greedy fold, and the survivors with what they absorbed.
Pairs are not all looked at: they come from blocks of which no pair of the least useful score can avoid all, and those that
cannot reach it are dropped inside the blocks' joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.geo import RADIUS, cell, metres, neighbour_cells
from larkspur.functions.numbers import known
from larkspur.operators.steps import Steps

# Place tiers from the finest, with points, near and far in metres, and the points of a shared name.
TIERS = ("gps", "street", "part", "quarter", "town")
GPS = {"gps": (35, 100, 1500), "street": (35, 400, 2500), "part": (20, 1200, 5000), "quarter": (10, 3000, 12000), "town": (6, 5000, 25000)}
NAME_POINTS = {"street": 30, "part": 5, "quarter": 5, "town": 2}
SMALL = 5
STREETS_DISAGREE, NOTHING_SHARED = -35, -8
LAYOUT_SAME, LAYOUT_DIFFERENT = 15, -35
PRICE_SHARE, PRICE_POINTS, PRICE_FALL, PRICE_LOSS = 0.10, 15, 0.20, 25
SIZE_SAME, SIZE_NEAR, SIZE_POINTS, SIZE_FALL, SIZE_LOSS = 2, 6, 10, 10, 15
MATCH, UNCERTAIN = 55, 30
#: Records of a block that one part of a candidate join takes.
HOT_BLOCK = 1_000


def gps_points(metres_apart: Column, tier: Column) -> Column:
    """From plus to minus the looser tier's points between its near and far; 0 for other tiers."""
    of = lambda n: F.element_at(F.create_map(*(x for t, v in GPS.items() for x in (F.lit(t), F.lit(float(v[n]))))), tier)
    return F.when(tier.isin(*GPS), F.coalesce(F.greatest(-of(0), F.least(of(0), of(0) - 2.0 * of(0) * (metres_apart - of(1)) / (of(2) - of(1)))), F.lit(0.0))).otherwise(0.0)


def looser_tier(a: Column, b: Column) -> Column:
    """The less exact of two place tiers; null if either is missing or none of ``TIERS``."""
    rank = lambda t: F.array_position(F.array(*(F.lit(x) for x in TIERS)), t)
    place = F.greatest(rank(a), rank(b))
    both = (rank(a) > 0) & (rank(b) > 0)
    return F.when(both, F.element_at(F.array(*(F.lit(x) for x in TIERS)), F.when(both, place).otherwise(1).cast("int")))


def place_evidence(lat: Column, lon: Column, unit_lat: Column, unit_lon: Column, unit_kind: Column) -> Column:
    """lat, lon and tier of a record: its own position, else that of its finest unit, else null."""
    at = lambda y, x, t: F.struct(y.alias("lat"), x.alias("lon"), t.alias("tier"))
    return F.when(lat.isNotNull() & lon.isNotNull(), at(lat, lon, F.lit("gps"))).when(unit_kind.isNotNull(), at(unit_lat, unit_lon, unit_kind))


def shared_tier(a: Column, b: Column) -> Column:
    """The most exact tier of a name that both have (arrays of name and tier), each at the looser of the two sides; null without one."""
    rank = lambda t: F.array_position(F.array(*(F.lit(x) for x in TIERS)), t)
    shared = F.transform(a, lambda x: F.array_min(F.transform(F.filter(b, lambda y: y["name"] == x["name"]), lambda y: F.greatest(rank(x["tier"]), rank(y["tier"])))))
    best = F.array_min(shared)
    return F.when(best > 0, F.element_at(F.array(*(F.lit(x) for x in TIERS)), F.greatest(best, F.lit(1)).cast("int")))


def streets_disagree(a: Column, b: Column) -> Column:
    """Whether both sides name streets and none in common."""
    streets = lambda names: F.transform(F.filter(names, lambda n: n["tier"] == "street"), lambda n: n["name"])
    return (F.size(streets(a)) > 0) & (F.size(streets(b)) > 0) & ~F.arrays_overlap(streets(a), streets(b))


def name_points(shared_tier: Column, streets_disagree: Column, both_named: Column | None = None) -> Column:
    """Points of the names; 0 (and no evidence) where a side has none."""
    out = F.when(~both_named, 0.0).when(streets_disagree, float(STREETS_DISAGREE)) if both_named is not None else F.when(streets_disagree, float(STREETS_DISAGREE))
    for name, points in NAME_POINTS.items():
        out = out.when(shared_tier == name, float(points))
    return out.otherwise(float(NOTHING_SHARED))


def score(pairs: DataFrame, estate: str, id_: str = "ord") -> DataFrame:
    """i, j, the points of the five factors, evidence, total and band of each pair a, b.

    Records have lat, lon and tier (their place's evidence, null if none), names (array of name and tier; empty if none is known),
    has_names, layout, price, size and land.  One projection: no shuffle, no Python.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    tier = looser_tier(a("tier"), b("tier"))
    apart = metres(a("lat"), a("lon"), b("lat"), b("lon"))
    named = a("has_names") & b("has_names")
    factors = {
        "gps": F.when(tier.isNotNull(), gps_points(apart, tier)).otherwise(0.0),
        "shared_name": name_points(shared_tier(a("names"), b("names")), streets_disagree(a("names"), b("names")), named),
        "layout": layout_points(a("layout"), b("layout")),
        "price": price_points(a("price"), b("price")),
        "size": size_points(a("size"), b("size")),
    }
    agrees = property_agrees(estate, *(side(c) for c in ("layout", "price", "size", "land") for side in (a, b)))
    found = F.struct(*(v.alias(k) for k, v in factors.items()), tier.isNotNull().alias("gps_evidence"), named.alias("name_evidence"), agrees.alias("agrees"))
    rows = pairs.select(a(id_).alias("i"), b(id_).alias("j"), F.inline(F.array(found)))  # factors once: total and band stay above them
    total = sum((F.col(k) for k in list(factors)[1:]), F.col("gps"))
    return rows.withColumn("total", total).withColumn("band", band(total, F.col("gps_evidence") | F.col("name_evidence"), F.col("agrees")))


def richer_first(a_facts: Column, b_facts: Column) -> Column:
    """Whether the earlier record of a pair is kept: it knows as much or more."""
    return a_facts >= b_facts


def absorbed_sources(merged: DataFrame, records: DataFrame, id_: str = "ord", source: str = "source") -> DataFrame:
    """keeper and the sources merged into it, each once in the order of merging, without its own.  merged: removed, keeper (the last one), seq."""
    own = lambda c, s: records.select(F.col(id_).alias(c), F.col(source).alias(s))
    rows = merged.join(own("removed", "_of"), "removed").join(own("keeper", "_own"), "keeper").where("_of <> _own")
    return rows.groupBy("keeper").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_of"))), lambda x: x["_of"])).alias("sources"))


def promoted(kept: dict[str, Column], absorbed: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """The facts of a kept record with gaps filled from an absorbed one, and a map of where the two differ (field to the absorbed
    value as text)."""
    canonical = {k: F.coalesce(v, absorbed[k]) for k, v in kept.items()}
    text = lambda c: c.cast("string")
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.when(absorbed[k].isNotNull() & (text(absorbed[k]) != text(canonical[k])), text(absorbed[k])).alias("value")) for k in kept))
    return canonical, F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def name_tiers(listings: DataFrame, places: DataFrame) -> DataFrame:
    """id and names (array of name and tier): for each candidate name (id, names, town_norm) the coarsest kind that carries it in the
    listing's town, or in the whole register where the town is not known."""
    rank = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("kind"))
    units = places.where(rank > 0).groupBy("name_norm", "town_norm").agg(F.max(rank).alias("rank"))
    anywhere = units.groupBy("name_norm").agg(F.max("rank").alias("rank")).withColumn("town_norm", F.lit(None).cast("string"))
    asked = listings.select("id", "town_norm", F.explode("names").alias("name_norm")).distinct()
    found = asked.join(units.unionByName(anywhere), (asked["name_norm"] == units["name_norm"]) & asked["town_norm"].eqNullSafe(units["town_norm"]))
    tier = F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("rank").cast("int"))
    return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(asked["name_norm"].alias("name"), tier.alias("tier")))).alias("names"))


def layout_points(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, float(LAYOUT_SAME)).otherwise(float(LAYOUT_DIFFERENT))


def price_gap(a: Column, b: Column) -> Column:
    """Difference as a share of the higher price; null if either is missing or zero."""
    return F.when(known(a) & known(b), F.abs(a - b) / F.greatest(a, b))


def price_points(a: Column, b: Column) -> Column:
    gap = price_gap(a, b)
    near = PRICE_POINTS * (1 - gap / PRICE_SHARE)
    return F.when(gap.isNull(), 0.0).when(gap <= PRICE_SHARE, near).otherwise(-PRICE_LOSS * F.least(F.lit(1.0), (gap - PRICE_SHARE) / PRICE_FALL))


def size_points(a: Column, b: Column) -> Column:
    gap = F.when(known(a) & known(b), F.abs(a - b))
    near = SIZE_POINTS * (1 - (gap - SIZE_SAME) / (SIZE_NEAR - SIZE_SAME))
    return F.when(gap.isNull(), 0.0).when(gap <= SIZE_SAME, float(SIZE_POINTS)).when(gap <= SIZE_NEAR, near).otherwise(-SIZE_LOSS * F.least(F.lit(1.0), (gap - SIZE_NEAR) / SIZE_FALL))


def property_agrees(estate: str, layout_a, layout_b, price_a, price_b, size_a, size_b, land_a, land_b) -> Column:
    """What a match needs beside its score."""
    no = F.lit(False)
    prices = F.coalesce(price_gap(price_a, price_b) <= PRICE_SHARE, no)
    sizes = F.coalesce(F.when(known(size_a) & known(size_b), F.abs(size_a - size_b) <= SIZE_NEAR), no)
    plots = F.coalesce(price_gap(land_a, land_b) <= PRICE_SHARE, no)
    if estate == "land":
        return prices & plots
    if estate == "house":
        return prices & ~F.coalesce(layout_a != layout_b, no) & (sizes | plots)
    return prices & F.coalesce(layout_a == layout_b, no) & sizes


def band(total: Column, evidence: Column, agrees: Column) -> Column:
    return F.when(~evidence | (total < UNCERTAIN), "no_match").when((total >= MATCH) & agrees, "match").otherwise("uncertain")


def price_block(price: Column, share: float = PRICE_SHARE) -> Column:
    """Prices within the share of each other lie in the same block or in blocks next to each other."""
    return F.when(known(price), F.floor(F.log(price.cast("double")) / -math.log(1 - share)))


def size_block(size: Column) -> Column:
    """Sizes that give points lie in the same block or in blocks next to each other."""
    return F.when(known(size), F.floor(size.cast("double") / SIZE_NEAR))


def candidates(records: DataFrame, *equal: str, price: str | None = "price", id_: str = "ord", source: str = "source") -> DataFrame:
    """Pairs a, b of records (as structs, a before b in input order) of different sources that agree in ``equal`` and
    whose prices may be within the share: one equi-join on the block.  Without ``price``, whatever their prices."""
    own = [F.col(c).alias(f"_{c}") for c in equal]
    if price is None:
        return _meet(records.select(F.struct("*").alias("a"), *own), records.select(F.struct("*").alias("b"), *own), [f"_{c}" for c in equal], id_, source)
    one = records.select(F.struct("*").alias("a"), *own, F.explode(F.array(*(price_block(F.col(price)) + k for k in (-1, 0, 1)))).alias("_block"))
    two = records.select(F.struct("*").alias("b"), *own, price_block(F.col(price)).alias("_block"))
    return _meet(one, two, [f"_{c}" for c in equal] + ["_block"], id_, source)


def _meet(one: DataFrame, two: DataFrame, keys: list[str], id_: str, source: str, *kept: Column, ordered: bool = True) -> DataFrame:
    """The pairs a, b of equal keys, a before b (unless not ``ordered``, but never a record with itself) and of different sources, and kept columns.

    Blocks with more than ``HOT_BLOCK`` records on the side of b are dealt over several parts: a record a is in one of them, b in all.
    """
    hot = two.groupBy(keys).count().where(F.col("count") > HOT_BLOCK).select(*keys, F.ceil(F.col("count") / HOT_BLOCK).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    one = one.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(f"a.{id_}"), parts).cast("int"))
    two = two.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # both are dealt by key whatever their size: the work lies in the pairs, and records out of one file would all be met in one task
    n = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.drop("_parts").repartition(n, *keys, "_part")
    pairs = dealt(one).join(dealt(two).hint("merge"), [*keys, "_part"])
    apart = F.col(f"a.{id_}") < F.col(f"b.{id_}") if ordered else F.col(f"a.{id_}") != F.col(f"b.{id_}")
    return pairs.where(apart & (F.col(f"a.{source}") != F.col(f"b.{source}"))).select("a", "b", *kept)


def _cells(reach: float, lat: Column, lon: Column) -> Column:
    """The cell of a point in a grid whose cells are as wide as the reach needs up to 70 degrees of latitude."""
    side = reach / (RADIUS * math.pi / 180)
    return cell(lat, lon, side, side / math.cos(math.radians(70)))


def nearby(records: DataFrame, reach: float, id_: str = "ord", source: str = "source") -> DataFrame:
    """Pairs of different sources within reach metres or a little more: an equi-join of grid cells with their neighbours."""
    at = _cells(reach, F.col("lat"), F.col("lon"))
    one = records.where("lat is not null and lon is not null").select(F.struct("*").alias("a"), F.explode(neighbour_cells(at)).alias("_cell"))
    two = records.where("lat is not null and lon is not null").select(F.struct("*").alias("b"), at.alias("_cell"))
    return _meet(one, two, ["_cell"], id_, source).where(metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= reach).select("a", "b")


def _span(x: Column, reach: float) -> tuple[Column, Column]:
    """The one or two blocks, as wide as twice the reach, that hold all values within reach of x; and the block of x."""
    reach *= 1 + 1e-6
    block = lambda y: F.floor(y / (2 * reach))
    return F.array_distinct(F.array(block(x - reach), block(x + reach))), block(x)


def _price_span(price: Column, share: float = PRICE_SHARE) -> tuple[Column, Column]:
    return _span(F.when(known(price), F.log(price.cast("double"))), -math.log(1 - share))


def _size_span(size: Column) -> tuple[Column, Column]:
    return _span(F.when(known(size), size.cast("double")), float(SIZE_NEAR))


def _cell_spans(tier: str, least: float = 0.0) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Cells of places that may be exact to the tier, within the distance up to which it gives the least points (up to 70 degrees of latitude)."""
    points, low, high = GPS[tier]
    side = (low + (high - low) * (points - least) / (2 * points) + 1) / (RADIUS * math.pi / 180)
    here = (F.col("_rank") > 0) & (F.col("_rank") <= TIERS.index(tier) + 1)
    return _span(F.when(here, F.col("lat")), side), _span(F.when(here, F.col("lon")), side / math.cos(math.radians(70)))


def _keys(tag: int, *parts: tuple[str, str], names: str | None = None) -> tuple[str, str]:
    """Keys of a block for the side of a (with tag and name) and for that of b, in SQL: hashes of the tag, of a name (each of ``names``,
    if given) and of the parts, which are the blocks that a record meets and its own one."""
    name = "CAST(NULL AS STRING)" if names is None else "n"
    around, own = "array(0L)", "0L"
    for k, (many, one) in enumerate(parts):
        around, own = f"flatten(transform({around}, x{k} -> transform({many}, y{k} -> xxhash64(x{k}, y{k}))))", f"xxhash64({own}, {one})"
    given = " AND ".join(["true", *(f"{one} IS NOT NULL" for _, one in parts)])
    end = f"xxhash64({tag}, {name}, {{}})".format
    sides = f"transform({around}, x -> named_struct('key', {end('x')}, 'tag', {tag}, 'name', {name}))", f"array({end(own)})"
    sides = sides if names is None else tuple(f"flatten(transform({names}, n -> {s}))" for s in sides)
    empty = "array<struct<key:bigint,tag:int,name:string>>", "array<bigint>"
    return tuple(f"CASE WHEN {given} THEN {s} ELSE CAST(array() AS {kind}) END" for s, kind in zip(sides, empty))


def _joined(keys: list[tuple[str, str]], n: int) -> str:
    return f"concat({', '.join(k[n] for k in keys)})"


def _with_spans(records: DataFrame, spans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Spans as a column, since keys are made of them many times over: parts of blocks are made of them by ``_span_of``."""
    return records.withColumn("_spans", F.struct(*(F.struct(many.alias("many"), own.alias("own")).alias(k) for k, (many, own) in spans.items())))


def _span_of(name: str) -> tuple[str, str]:
    return f"_spans.`{name}`.many", f"_spans.`{name}`.own"


LAYOUT = ("array(layout)", "layout")


def most_points(a, b) -> Column:
    """What the total of a pair is at most, by its parts, as a struct: as ``score`` has them, but for names of which none is shared, which
    count nothing here.  Sides are as ``_with_names`` has them: the looser tier has the fewer points, the farther near and the farther far."""
    chord = F.pow(a("_x") - b("_x"), 2) + F.pow(a("_y") - b("_y"), 2) + F.pow(a("_z") - b("_z"), 2)
    points, near = F.least(a("_points"), b("_points")), F.greatest(a("_near"), b("_near"))
    fall = 2.0 * points * (2 * RADIUS * F.asin(F.least(F.sqrt(chord) / 2, F.lit(1.0))) - 1.0 - near) / (F.greatest(a("_far"), b("_far")) - near)
    placed = (a("_rank") > 0) & (b("_rank") > 0)
    both = (F.size(a("_streets")) > 0) & (F.size(b("_streets")) > 0)
    names = F.when(F.arrays_overlap(a("_streets"), b("_streets")), float(NAME_POINTS["street"])).when(both, float(STREETS_DISAGREE))
    names = names.when(F.arrays_overlap(a("_small"), b("_small")), float(SMALL)).otherwise(float(NAME_POINTS["town"]))
    return F.struct(
        F.when(placed, F.greatest(a("_rank"), b("_rank"))).otherwise(0).alias("tier"),
        F.when(placed & chord.isNotNull(), F.greatest(-points, F.least(points, points - fall))).otherwise(0.0).alias("gps"),
        names.alias("names"),
        layout_points(a("layout"), b("layout")).alias("layout"),
        price_points(a("price"), b("price")).cast("double").alias("price"),
        size_points(a("size"), b("size")).cast("double").alias("size"),
    )


def useful(records: DataFrame, id_: str = "ord", source: str = "source", small_block: int = HOT_BLOCK) -> DataFrame:
    """All pairs a, b that can have a total of ``UNCERTAIN`` or more, each once, and few others: each comes from the one block that its factors name.

    * Equal layouts: all pairs of a layout of few records.  Of one with more than ``small_block`` those with near price and size, a price that
      gives 10 alone, a shared street, a place nearer than half way from near to far of the looser tier (beyond, a place gives nothing; a tier
      of few points needs a near price or size beside it), or another shared name with a near size or place.
    * Different layouts: a shared street at a place that gives 10 (with a near price where the tier gives 20 at most), or another
      shared name with the same price and a near size; nothing else makes up for the loss.
    * A layout that is not known: a shared street, a near place (with price or size where the tier is not exact), or a shared name with the same price and a near size.

    Pairs that miss the total are dropped in the join.
    """
    sizes = records.groupBy("layout").count()
    most = sizes.agg(F.max(F.when(F.col("layout").isNotNull(), F.col("count"))).alias("known"), F.max(F.when(F.col("layout").isNull(), F.col("count"))).alias("blank")).first()
    some_large, some_blank = (most.known or 0) > small_block, bool(most.blank)
    rows = records.withColumn("_large", F.lit(False))
    if some_large:
        large = sizes.where((F.col("count") > small_block) & F.col("layout").isNotNull()).select(F.col("layout").alias("_l"))
        rows = records.join(large, F.col("layout") == F.col("_l"), "left").withColumn("_large", F.col("_l").isNotNull()).drop("_l")
    rows = _with_names(rows)
    whole = F.struct(*(F.col(c) for c in rows.columns))
    spans = {"price": _price_span(F.col("price")), "ten": _price_span(F.col("price"), PRICE_SHARE * (1 - 9.9 / PRICE_POINTS)), "same": _price_span(F.col("price"), PRICE_SHARE / 100), "size": _size_span(F.col("size"))}
    spans |= {f"{way} {t}{'' if least == 0 else ' 10'}": own for t in TIERS for least in ((0.0, 9.9) if t in ("gps", "street", "part") else (0.0,)) for way, own in zip(("lat", "lon"), _cell_spans(t, least))}
    rows = _with_spans(rows, spans)
    price, ten, same, size = map(_span_of, ("price", "ten", "same", "size"))
    cells = {t: (_span_of(f"lat {t}"), _span_of(f"lon {t}")) for t in TIERS}
    exact, close, vague = ("gps", "street"), ("gps", "street", "part"), ("quarter", "town")
    tags = {n: k for k, n in enumerate((
        "layout", "facts", "ten", "street", *(f"place {t}" for t in TIERS), *(f"size {t}" for t in vague), "name size", "name place",
        *(f"street {t}" for t in close), "name", "open street", *(f"open {t}" for t in TIERS), "open part size", "open name"))}
    several = [_keys(tags["facts"], LAYOUT, price, size), _keys(tags["ten"], LAYOUT, ten), _keys(tags["street"], LAYOUT, names="_streets")]
    several += [_keys(tags[f"place {t}"], LAYOUT, *cells[t]) for t in close] + [_keys(tags[f"place {t}"], LAYOUT, *cells[t], price) for t in vague] + [_keys(tags[f"size {t}"], LAYOUT, *cells[t], size) for t in vague]
    several += [_keys(tags["name size"], LAYOUT, size, names="_small"), _keys(tags["name place"], LAYOUT, *cells["quarter"], names="_small")]
    apart = [_keys(tags[f"street {t}"], _span_of(f"lat {t} 10"), _span_of(f"lon {t} 10"), *((price,) if t == "part" else ()), names="_streets") for t in close] + [_keys(tags["name"], same, size, names="_small")]
    open_ = [_keys(tags["open street"], names="_streets"), _keys(tags["open name"], same, size, names="_small"), _keys(tags["open part size"], *cells["part"], size)]
    open_ += [_keys(tags[f"open {t}"], *cells[t], *(() if t in exact else (price,) if t != "town" else (price, size))) for t in TIERS]
    one = _keys(tags["layout"], LAYOUT)
    equal_ = tuple(f"CASE WHEN _large THEN {_joined(several, n)} ELSE {one[n]} END" for n in (0, 1)) if some_large else one

    def side(df: DataFrame, name: str, n: int, keys: list) -> DataFrame:
        found = df.select(whole.alias(name), F.explode(F.expr(_joined(keys, n))).alias("_k"))
        return found.select(name, F.col("_k.key").alias("_key"), F.col("_k.tag").alias("_tag"), F.col("_k.name").alias("_name")) if n == 0 else found.withColumnRenamed("_k", "_key")

    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    gives = lambda c, x=0.0: F.col(c) > x
    first = lambda c: F.array_min(F.array_intersect(a(c), b(c)))
    place = {t: k for k, t in enumerate(TIERS, 1)}
    at = lambda *tiers: F.col("tier").isin(*(place[t] for t in tiers))
    # the block a pair comes from, by its parts: the place of the tag, and the name where the block is one of names
    tag = lambda n: F.lit(tags[n])
    by = lambda prefix, *tiers: F.element_at(F.array(*(F.lit(tags.get(f"{prefix} {t}", -1)) for t in TIERS)), F.col("tier"))
    shares, small = gives("names", NAME_POINTS["street"] - 1), F.arrays_overlap(a("_small"), b("_small"))
    exactly = small & gives("price", 14.99) & gives("size")
    equal = F.when(gives("price") & gives("size"), tag("facts")).when(gives("price", 9.99), tag("ten")).when(shares, tag("street")).when(gives("gps") & at(*close), by("place"))
    equal = equal.when(gives("gps") & at(*vague) & gives("price"), by("place")).when(gives("gps") & at(*vague) & gives("size"), by("size")).when(small & gives("size"), tag("name size")).when(small & gives("gps") & at("quarter"), tag("name place"))
    equal = F.when(~a("_large"), tag("layout")).otherwise(equal) if some_large else tag("layout")
    different = F.when(shares & gives("gps", 9.99) & (at(*exact) | at("part") & gives("price")), by("street")).when(exactly, tag("name"))
    unknown = F.when(shares, tag("open street")).when(gives("gps") & (at(*exact) | at("part") & gives("price")), by("open")).when(gives("gps") & at("part") & gives("size"), tag("open part size"))
    unknown = unknown.when(gives("gps") & gives("price") & (at("quarter") | at("town") & gives("size")), by("open")).when(exactly, tag("open name"))
    named = lambda *names: F.col("_tag").isin(*(tags[n] for n in names))
    in_street = named("street", "open street", *(f"street {t}" for t in close))
    label = F.when(in_street, first("_streets")).when(named("name", "open name", "name size", "name place"), first("_small"))

    def chosen(met: DataFrame, block: Column) -> DataFrame:
        parts = met.select("a", "b", "_tag", "_name", F.inline(F.array(most_points(a, b))))  # once a pair: a filter over it stays above
        enough = F.col("gps") + F.col("names") + F.col("layout") + F.col("price") + F.col("size") >= UNCERTAIN - 1e-4
        return parts.where(enough & (F.col("_tag") == block) & F.col("_name").eqNullSafe(label))

    known_rows = rows.where("layout is not null")
    met = _meet(side(known_rows, "a", 0, [equal_, *apart]), side(known_rows, "b", 1, [equal_, *apart]), ["_key"], id_, source, F.col("_tag"), F.col("_name"))
    out = chosen(met, F.when(gives("layout"), equal).otherwise(different)).select("a", "b")
    if some_blank:
        both = _meet(side(rows.where("layout is null"), "a", 0, open_), side(rows, "b", 1, open_), ["_key"], id_, source, F.col("_tag"), F.col("_name"), ordered=False)
        turned = a(id_) < b(id_)
        both = chosen(both.where(b("layout").isNotNull() | turned), unknown)
        out = out.unionByName(both.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b")))
    given = lambda x: F.struct(*(F.col(f"{x}.{c}").alias(c) for c in records.columns)).alias(x)
    return out.select(given("a"), given("b"))


def _with_names(records: DataFrame) -> DataFrame:
    """Records with ``_streets`` and ``_small`` (names that give as much as a part's or more), ``_rank`` of the tier (0 without one), its
    points, near and far, and the place on the sphere: what a pair needs is worked out once a record."""
    of = lambda *tiers: F.expr("array_distinct(coalesce(transform(filter(names, n -> n.tier IN (" + ", ".join(map(repr, tiers)) + ") AND n.name IS NOT NULL), n -> n.name), CAST(array() AS array<string>)))")
    dealt = records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *records.columns[:1])  # keys are many times the records
    rows = dealt.withColumn("_streets", of("street")).withColumn("_small", of(*(t for t in TIERS if NAME_POINTS.get(t, 0) >= SMALL)))
    rows = rows.withColumn("_rank", F.coalesce(F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier")), F.lit(0)).cast("int"))
    of = lambda n: F.coalesce(*(F.when(F.col("tier") == t, float(v[n])) for t, v in GPS.items()))
    lat, lon = F.radians("lat"), F.radians("lon")
    place = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    return rows.withColumns({"_points": of(0), "_near": of(1), "_far": of(2)} | place)


def matching(records: DataFrame, estate: str, id_: str = "ord", source: str = "source") -> DataFrame:
    """All pairs a, b that can be matches, each once, and few others: what ``property_agrees`` asks for, and a shared street or near place.

    Prices are near; flats have equal layouts and near sizes, land has near plots, houses one of both.  Layout, price and size give 40 at
    most, so place and names must give 15: a shared street, a place that gives 10 in a tier of more, or in the quarter's tier beside another shared name.
    """
    rows = _with_names(records)
    whole = F.struct(*(F.col(c) for c in rows.columns))
    near = ("gps", "street", "part", "quarter")
    spans = {"price": _price_span(F.col("price")), "size": _size_span(F.col("size")), "land": _price_span(F.col("land"))}
    spans |= {f"{way} {t}": own for t in near for way, own in zip(("lat", "lon"), _cell_spans(t, 9.9))}
    rows = _with_spans(rows, spans)
    price, size, land = map(_span_of, ("price", "size", "land"))
    facts = {"flat": [(LAYOUT, price, size)], "land": [(price, land)]}.get(estate, [(price, size), (price, land)])
    keys = []
    for k, parts in enumerate(facts):
        keys.append(_keys(10 * k, *parts, names="_streets"))
        keys += [_keys(10 * k + n, *parts, _span_of(f"lat {t}"), _span_of(f"lon {t}"), names="_small" if t == "quarter" else None) for n, t in enumerate(near, 1)]
    one = rows.select(whole.alias("a"), F.explode(F.expr(_joined(keys, 0))).alias("_k")).select("a", F.col("_k.key").alias("_key"), F.col("_k.tag").alias("_tag"), F.col("_k.name").alias("_name"))
    two = rows.select(whole.alias("b"), F.explode(F.expr(_joined(keys, 1))).alias("_key"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    agrees = property_agrees(estate, *(side(c) for c in ("layout", "price", "size", "land") for side in (a, b)))
    met = _meet(one, two, ["_key"], id_, source, F.col("_tag"), F.col("_name")).where(agrees)
    parts = met.select("a", "b", "_tag", "_name", F.inline(F.array(most_points(a, b))))  # once a pair: a filter over it stays above
    enough = F.col("gps") + F.col("names") + F.col("layout") + F.col("price") + F.col("size") >= MATCH - 1e-4
    sizes = F.coalesce(F.when(known(a("size")) & known(b("size")), F.abs(a("size") - b("size")) <= SIZE_NEAR), F.lit(False))
    street = F.col("names") >= NAME_POINTS["street"]
    block = F.when(sizes | F.lit(len(facts) == 1), 0).otherwise(10) + F.when(street, 0).otherwise(F.col("tier"))
    label = F.when(street, F.array_min(F.array_intersect(a("_streets"), b("_streets")))).when(F.col("tier") == len(near), F.array_min(F.array_intersect(a("_small"), b("_small"))))
    given = lambda x: F.struct(*(F.col(f"{x}.{c}").alias(c) for c in records.columns)).alias(x)
    return parts.where(enough & (F.col("_tag") == block) & F.col("_name").eqNullSafe(label)).select(given("a"), given("b"))


def _meets(df: DataFrame, c: str, others: DataFrame, how: str) -> DataFrame:
    """df by whether its record c is among (g, r) of others."""
    return df.join(others.select(F.col("g").alias("_g"), F.col("r").alias("_r")), F.col("g").eqNullSafe(F.col("_g")) & (F.col(c) == F.col("_r")), how)


def _heads(undecided: DataFrame, steps: Steps) -> DataFrame:
    """g, r, head and odd of the records that one undecided pair alone can remove: where the chain of such records before each
    begins, and whether an odd number of pairs lies between.  Steps double, so a chain takes as many rounds as its length has bits."""
    chain = undecided.groupBy("g", F.col("j").alias("r")).agg(F.count("*").alias("n"), F.min("i").alias("head")).where("n = 1").select("g", "r", "head", F.lit(True).alias("odd"))
    chain = steps.written(chain)
    while True:
        up = chain.select(F.col("g").alias("_g"), F.col("r").alias("_r"), F.col("head").alias("_head"), F.col("odd").alias("_odd"))
        moved = chain.join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.col("head") == F.col("_r")), "left")
        moved = steps.written(moved.select("g", "r", F.coalesce("_head", "head").alias("head"), F.when(F.col("_head").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("_odd")).alias("odd"), F.col("_head").isNotNull().alias("_moved")))
        chain = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return chain


def greedy_merge(matches: DataFrame, group: str) -> DataFrame:
    """group, removed, keeper, seq: which record each removed one is merged into, at last, and the pair (turn, other) that removed it first.

    matches: group, i, j, keep_i (whether i is the richer one) with i < j.  Pairs are taken in the order of i, then j.  A pair is
    passed over if j is gone, or if i was gone before its own turn began; so merging is not transitive.

    A record is gone before its turn only by a pair (h, r) with keep_h whose h is not itself gone before its turn; a record that
    loses in its own turn stops no pair.  So the records gone early are found in rounds over those pairs: what no undecided
    pair can remove stays, what it removes is gone, and pairs of gone records are dropped.  Along chains, where a single pair
    can remove each record, every other one stays: they are decided in the round of their head, whatever their length.  All
    state is in the shared folder.
    """
    steps = Steps(matches.sparkSession, "greedy")
    pairs = steps.written(matches.select(F.col(group).alias("g"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "keep_i"))
    taking = pairs.where("keep_i").select("g", "i", "j")
    undecided, gone = taking, taking.select("g", F.col("j").alias("r")).limit(0)
    while not undecided.isEmpty():
        removable = undecided.select("g", F.col("j").alias("r")).distinct()
        roots = _meets(undecided, "i", removable, "left_anti").select("g", F.col("i").alias("r")).distinct()
        chained = _meets(_heads(undecided, steps), "head", removable, "left_anti").where("not odd").select("g", "r")
        staying = steps.written(roots.unionByName(chained))
        lost = steps.written(_meets(undecided, "i", staying, "left_semi").select("g", F.col("j").alias("r")).distinct())
        gone = steps.written(gone.unionByName(lost))
        undecided = steps.written(_meets(_meets(_meets(undecided, "i", lost, "left_anti"), "j", lost, "left_anti"), "i", staying, "left_anti"))
    seq = lambda turn, other: F.struct(turn.alias("turn"), other.alias("other")).alias("seq")
    by = _meets(taking, "i", gone, "left_anti").groupBy("g", F.col("j").alias("removed")).agg(F.min("i").alias("keeper")).withColumn("seq", seq(F.col("keeper"), F.col("removed")))
    own = _meets(pairs.where("not keep_i"), "i", gone, "left_anti")
    taken = by.select(F.col("g").alias("_g"), F.col("removed").alias("_r"), F.col("keeper").alias("_turn"))
    own = own.join(taken, F.col("g").eqNullSafe(F.col("_g")) & (F.col("j") == F.col("_r")), "left").where("_turn is null or _turn >= i")
    own = own.groupBy("g", F.col("i").alias("removed")).agg(F.max("j").alias("keeper"), seq(F.first("i"), F.min("j")))
    return steps.last(by.unionByName(own).select(F.col("g").alias(group), "removed", "keeper", "seq"))


def final_keepers(merged: DataFrame, group: str) -> DataFrame:
    """Follow keepers that are removed themselves to the last one, by doubling the step; chains that end in a circle end after as many
    rounds as their length has bits.  The state of each round is a table in the shared folder."""
    steps = Steps(merged.sparkSession, "keepers")
    more = [c for c in merged.columns if c not in (group, "removed", "keeper")]
    current = steps.written(merged.select(group, "removed", "keeper", *more))
    for _ in range(64):
        up = current.select(F.col(group).alias("_g"), F.col("removed").alias("_r"), F.col("keeper").alias("_k"))
        moved = current.join(up, F.col(group).eqNullSafe(F.col("_g")) & (F.col("keeper") == F.col("_r")) & (F.col("_k") != F.col("removed")), "left")
        moved = steps.written(moved.select(group, "removed", F.coalesce("_k", "keeper").alias("keeper"), *more, F.col("_k").isNotNull().alias("_moved")))
        current = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    return steps.last(current)


def matches_of(scored: DataFrame, facts: DataFrame, id_: str = "ord", known: str = "facts") -> DataFrame:
    """The matches among scored pairs as the fold takes them: all in one group, with whether i knows as much as j or more."""
    of = lambda c, side: facts.select(F.col(id_).alias(c), F.col(known).alias(side))
    pairs = scored.where("band = 'match'").select("i", "j").join(of("i", "_a"), "i").join(of("j", "_b"), "j")
    return pairs.select(F.lit(0).alias("group"), "i", "j", richer_first(F.col("_a"), F.col("_b")).alias("keep_i"))


def survivors(records: DataFrame, merged: DataFrame, id_: str = "ord", source: str = "source") -> DataFrame:
    """The records that nothing removed, with the sources merged into each; they keep their place in the input, which is ``id_``."""
    final = final_keepers(merged, "group")
    left = records.join(final.select(F.col("removed").alias(id_)), id_, "left_anti")
    own = absorbed_sources(final, records, id_, source).withColumnRenamed("keeper", id_)
    return left.join(own, id_, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def link(records: DataFrame, estate: str, facts: str = "facts", id_: str = "ord", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linkage as a whole: survivors, merges (removed, keeper, seq) and all scored pairs of ``UNCERTAIN`` points or more.

    The fold looks at matches alone, which are few beside those pairs; the pairs are looked for when they are read, and again each time.

    ``facts`` is how much is known of a record: the richer one of a pair is kept, the earlier one where both know as much.
    """
    matches = score(matching(records, estate, id_, source), estate, id_).where(F.col("band") == "match")
    merged = greedy_merge(matches_of(matches, records, id_, facts), "group")
    scored = score(useful(records, id_, source), estate, id_).where(F.col("band") != "no_match")
    return survivors(records, merged, id_, source), merged.drop("group"), scored


def completeness(*facts: Column) -> Column:
    """How many facts are known."""
    return sum((f.isNotNull().cast("int") for f in facts), F.lit(0))


def evidence_json(total: Column, band_: Column, factors: dict[str, tuple[Column, Column]]) -> Column:
    """The audit record of a pair: total, band and what each factor gave."""
    listed = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("contribution"), e.alias("evidence")) for n, (v, e) in factors.items()))
    return F.to_json(F.struct(total.alias("total"), band_.alias("band"), listed.alias("factors")))
