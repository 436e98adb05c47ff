"""Registered queries of the place resolver, over a register and listings made of the given tables.

Suppliers are towns in the district of their nation (one in five lies in none and has boroughs instead), parts are streets of
towns, and customers are listings that name streets, parts, quarters, boroughs, towns and districts in several ways.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import HOUSE_NUMBER
from larkspur.operators import resolver
from larkspur.plans.catalog import registered, table

TOWNS = 40


def _letter(x):
    return F.chr(F.lit(65) + x)


def register_of(spark, sf_dir) -> resolver.Register:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    long = lambda c: F.col(c).cast("long")
    town = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        long("s_suppkey").alias("t"),
        F.when(F.col("s_suppkey") % 11 == 3, F.col("n_name")).otherwise(F.concat(F.lit("Town "), _letter(F.col("s_suppkey") % 7))).alias("town"),
        F.when(F.col("s_suppkey") % 5 != 0, long("n_nationkey")).alias("d"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).alias("dname"),
        long("n_regionkey").alias("g"),
    )
    none = F.lit(None).cast("long")

    def units(rows: DataFrame, kind: str, code, name, borough=none) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), code.alias("code"), name.alias("name"), F.lower(name).alias("name_norm"), F.col("t").alias("town_code"), F.lower("town").alias("town_norm"), F.col("d").alias("district_code"), F.lower("dname").alias("district_norm"), borough.cast("long").alias("borough_code"), F.col("g").alias("region_code"))

    k, t = F.col("k"), F.col("t")
    by = lambda rows, low, high: rows.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))
    with_quarters = town.where(t % 5 < 2)
    p = table(spark, sf_dir, "part").select(long("p_partkey").alias("p")).join(town, F.col("p") % TOWNS == t)
    street = F.when(F.col("p") % 4 == 0, F.concat(F.lit("Part "), _letter(F.col("p") % 6))).otherwise(F.concat(F.lit("Street "), _letter(F.col("p") % 13), _letter(F.col("p") % 7)))
    text = lambda c: F.lit(None).cast("string").alias(c)
    districts = nation.select(F.lit("district").alias("kind"), long("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_norm"), none.alias("town_code"), text("town_norm"), long("n_nationkey").alias("district_code"), F.lower("n_name").alias("district_norm"), none.alias("borough_code"), long("n_regionkey").alias("region_code"))
    regions = region.select(F.lit("region").alias("kind"), long("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lower("r_name").alias("name_norm"), none.alias("town_code"), text("town_norm"), none.alias("district_code"), text("district_norm"), none.alias("borough_code"), long("r_regionkey").alias("region_code"))
    places = reduce(
        DataFrame.unionByName,
        [
            units(town, "town", t, F.col("town")),
            units(by(town.where("d is null"), 1, 2), "borough", t * 10 + k, F.concat(F.lit("Borough "), k.cast("string")), t * 10 + k),
            units(by(with_quarters, 1, 3), "quarter", t * 10 + k, F.concat(F.lit("Quarter "), _letter((k + t) % 4)), F.when(F.col("d").isNull(), t * 10 + 1 + k % 2)),
            units(by(town, 0, 3), "part", t * 10 + k, F.when(k == 0, F.col("town")).otherwise(F.concat(F.lit("Part "), _letter((k + t) % 6)))),
            units(p, "street", F.col("p"), street),
            districts,
            regions,
        ],
    )
    pairs = lambda rows, a, b, more, second: rows.select(a.alias("a"), F.explode(F.array_compact(F.array(b, F.when(more, second)))).alias("b"))
    n = F.col("p")
    quarters = pairs(p.where(t % 5 < 2), n, t * 10 + 1 + n % 3, n % 7 == 0, t * 10 + 1 + (n + 1) % 3).toDF("street_code", "quarter_code")
    parts = pairs(p, n, t * 10 + n % 4, n % 9 == 0, t * 10 + (n + 1) % 4).toDF("street_code", "part_code")
    of_part = pairs(by(with_quarters, 0, 3), t * 10 + k, t * 10 + 1 + k % 3, k == 2, t * 10 + 1 + (k + 1) % 3).toDF("part_code", "quarter_code")
    return resolver.Register(places, quarters, parts, of_part)


def listings_of(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    p, t = c * 7 % 200, c % TOWNS
    street = F.concat(F.lit("Street "), _letter(p % 13), _letter(p % 7))
    town = F.concat(F.lit("Town "), _letter(t % 7))
    part, quarter = F.concat(F.lit("Part "), _letter(c % 6)), F.concat(F.lit("Quarter "), _letter(c % 4))
    nation = F.concat(F.lit("NATION_"), (c % 25).cast("string"))
    ways = [
        F.array(street, town),
        F.array(part, quarter),
        F.array(town),
        F.array(F.concat(street, F.lit(" 12/3")), part, town),
        F.array(F.concat(F.lit("Borough "), (1 + c % 2).cast("string")), street, town),
        F.array(part, quarter, town),
        F.array(nation, street),
    ]
    names = reduce(lambda done, x: done.when(c % 7 == x[0], x[1]), enumerate(ways[1:], 1), F.when(c % 7 == 0, ways[0]))
    return table(spark, sf_dir, "customer").select(c.cast("long").alias("id"), names.alias("names"), F.when(c % 4 == 1, nation).alias("district"))


FORM = r"trim(regexp_replace(regexp_replace(lower({x}), '" + HOUSE_NUMBER + r"', ' ', 'g'), '\s+', ' ', 'g'))"
LETTER = "chr(CAST(65 + {x} AS INTEGER))".format
CTE = rf"""
WITH town AS (
  SELECT s_suppkey AS t, CASE WHEN s_suppkey % 11 = 3 THEN n_name ELSE 'Town ' || {LETTER(x='s_suppkey % 7')} END AS town,
         CASE WHEN s_suppkey % 5 <> 0 THEN n_nationkey END AS d, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS dname, n_regionkey AS g
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
), st AS (
  SELECT p_partkey AS p, CASE WHEN p_partkey % 4 = 0 THEN 'Part ' || {LETTER(x='p_partkey % 6')} ELSE 'Street ' || {LETTER(x='p_partkey % 13')} || {LETTER(x='p_partkey % 7')} END AS street, town.*
  FROM part JOIN town ON p_partkey % {TOWNS} = t
), places AS (
  SELECT kind, CAST(code AS BIGINT) AS code, name, lower(name) AS name_norm, t AS town_code, lower(town) AS town_norm, d AS district_code, lower(dname) AS district_norm, CAST(b AS BIGINT) AS borough_code, g AS region_code FROM (
    SELECT 'town' AS kind, t AS code, town AS name, NULL AS b, t, town, d, dname, g FROM town
    UNION ALL SELECT 'borough', t * 10 + k, 'Borough ' || k, t * 10 + k, t, town, d, dname, g FROM town, range(1, 3) r(k) WHERE d IS NULL
    UNION ALL SELECT 'quarter', t * 10 + k, 'Quarter ' || {LETTER(x='(k + t) % 4')}, CASE WHEN d IS NULL THEN t * 10 + 1 + k % 2 END, t, town, d, dname, g FROM town, range(1, 4) r(k) WHERE t % 5 < 2
    UNION ALL SELECT 'part', t * 10 + k, CASE WHEN k = 0 THEN town ELSE 'Part ' || {LETTER(x='(k + t) % 6')} END, NULL, t, town, d, dname, g FROM town, range(0, 4) r(k)
    UNION ALL SELECT 'street', p, street, NULL, t, town, d, dname, g FROM st)
  UNION ALL SELECT 'district', n_nationkey, n_name, lower(n_name), NULL, NULL, n_nationkey, lower(n_name), NULL, n_regionkey FROM nation
  UNION ALL SELECT 'region', r_regionkey, r_name, lower(r_name), NULL, NULL, NULL, NULL, NULL, r_regionkey FROM region
), sq AS (
  SELECT p AS street, t * 10 + 1 + p % 3 AS quarter FROM st WHERE t % 5 < 2 UNION ALL SELECT p, t * 10 + 1 + (p + 1) % 3 FROM st WHERE t % 5 < 2 AND p % 7 = 0
), sp AS (
  SELECT p AS street, t * 10 + p % 4 AS part FROM st UNION ALL SELECT p, t * 10 + (p + 1) % 4 FROM st WHERE p % 9 = 0
), pq AS (
  SELECT t * 10 + k AS part, t * 10 + 1 + k % 3 AS quarter FROM town, range(0, 4) r(k) WHERE t % 5 < 2 UNION ALL SELECT t * 10 + 2, t * 10 + 1 + 0 FROM town WHERE t % 5 < 2
), thru AS (
  SELECT 'street' AS kind, street AS code, quarter FROM sq UNION ALL SELECT 'part', part, quarter FROM pq UNION ALL SELECT 'quarter', code, code FROM places WHERE kind = 'quarter'
), touched AS (
  SELECT DISTINCT t.kind, t.code, 'quarter' AS ukind, quarter AS ucode FROM thru t JOIN places q ON q.kind = 'quarter' AND q.code = quarter
  UNION SELECT t.kind, t.code, 'borough', q.borough_code FROM thru t JOIN places q ON q.kind = 'quarter' AND q.code = quarter WHERE q.borough_code IS NOT NULL
  UNION SELECT 'street', street, 'part', part FROM sp
), raw AS (
  SELECT c_custkey AS c, 'Street ' || {LETTER(x='(c_custkey * 7 % 200) % 13')} || {LETTER(x='(c_custkey * 7 % 200) % 7')} AS s, 'Town ' || {LETTER(x=f'(c_custkey % {TOWNS}) % 7')} AS tn,
         'Part ' || {LETTER(x='c_custkey % 6')} AS pt, 'Quarter ' || {LETTER(x='c_custkey % 4')} AS q, 'NATION_' || c_custkey % 25 AS n FROM customer
), listings AS (
  SELECT c AS id, CASE c % 7 WHEN 0 THEN [s, tn] WHEN 1 THEN [pt, q] WHEN 2 THEN [tn] WHEN 3 THEN [s || ' 12/3', pt, tn] WHEN 4 THEN ['Borough ' || (1 + c % 2), s, tn] WHEN 5 THEN [pt, q, tn] ELSE [n, s] END AS names,
         CASE WHEN c % 4 = 1 THEN n END AS district FROM raw
), each_name AS (
  SELECT id, unnest(range(len(names))) AS name_place, unnest(names) AS name FROM listings
), forms AS (
  SELECT * FROM (SELECT id, name_place, 0 AS form, lower(name) AS nm FROM each_name UNION ALL SELECT id, name_place, 1, {FORM.format(x='name')} FROM each_name) WHERE nm <> ''
), own AS (
  SELECT id, nm, min(name_place * 2 + form) AS place FROM forms GROUP BY id, nm
), stated AS (
  SELECT DISTINCT id, nm FROM (SELECT id, lower(district) AS nm FROM listings WHERE district IS NOT NULL UNION ALL SELECT id, {FORM.format(x='district')} FROM listings WHERE district IS NOT NULL) WHERE nm <> ''
), asked AS (
  SELECT id, nm, place FROM own UNION ALL SELECT id, nm, 1000 FROM stated s WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.id = s.id AND o.nm = s.nm)
), pool AS (
  SELECT a.id, a.place, p.kind, p.code, p.name_norm, p.town_code, p.town_norm, p.district_norm FROM asked a JOIN places p ON p.name_norm = a.nm AND p.kind IN ('street', 'part', 'quarter', 'town', 'district')
  WHERE (p.kind = 'district' OR NOT EXISTS (SELECT 1 FROM stated s WHERE s.id = a.id AND s.nm = a.nm)) AND (p.kind IN ('district', 'town') OR p.name_norm IS DISTINCT FROM p.district_norm)
), inside AS (
  SELECT f.id, p.town_code, f.name_place, arg_min(p.code, f.form) FILTER (p.kind = 'borough') AS b, CASE WHEN min(p.code) FILTER (p.kind = 'quarter') = max(p.code) FILTER (p.kind = 'quarter') THEN min(p.code) FILTER (p.kind = 'quarter') END AS q
  FROM forms f JOIN (SELECT DISTINCT id, town_code FROM pool WHERE town_code IS NOT NULL) t ON t.id = f.id JOIN places p ON p.town_code = t.town_code AND p.name_norm = f.nm AND p.kind IN ('borough', 'quarter') GROUP BY 1, 2, 3
), named AS (
  SELECT DISTINCT id, town_code, CASE WHEN b IS NOT NULL THEN 'borough' ELSE 'quarter' END AS ukind, coalesce(b, q) AS ucode FROM inside WHERE coalesce(b, q) IS NOT NULL
), fit AS (
  SELECT p.*, p.kind = 'town' OR NOT EXISTS (SELECT 1 FROM named n WHERE n.id = p.id AND n.town_code = p.town_code AND NOT EXISTS (
    SELECT 1 FROM touched t WHERE t.kind = p.kind AND t.code = p.code AND t.ukind = n.ukind AND t.ucode = n.ucode)) AS fits FROM pool p WHERE p.kind <> 'district'
), pruned AS (
  SELECT id, place, kind, code, name_norm, town_code, town_norm, district_norm FROM (SELECT *, count(*) OVER w AS n, bool_or(fits) OVER w AS fitted FROM fit WINDOW w AS (PARTITION BY id, town_code, name_norm)) WHERE n = 1 OR fits OR NOT fitted
  UNION ALL SELECT id, place, kind, code, name_norm, town_code, town_norm, district_norm FROM pool WHERE kind = 'district'
), ranked AS (
  SELECT *, CASE kind WHEN 'street' THEN 1 WHEN 'part' THEN 2 WHEN 'quarter' THEN 3 WHEN 'town' THEN 4 ELSE 5 END AS rank FROM pruned
), readings AS (
  SELECT 1 AS pass, r.* FROM ranked r WHERE kind <> 'district' AND town_norm <> name_norm AND EXISTS (SELECT 1 FROM own o WHERE o.id = r.id AND o.nm = r.town_norm) AND NOT EXISTS (SELECT 1 FROM stated s WHERE s.id = r.id AND s.nm = r.town_norm)
  UNION ALL SELECT 2, r.* FROM ranked r WHERE kind <> 'district' AND district_norm <> name_norm AND EXISTS (SELECT 1 FROM ranked d WHERE d.id = r.id AND d.kind = 'district' AND d.name_norm = r.district_norm)
  UNION ALL SELECT 3, r.* FROM ranked r WHERE kind <> 'district' AND (SELECT count(DISTINCT x.town_code) FROM ranked x WHERE x.id = r.id AND x.name_norm = r.name_norm AND x.kind <> 'district') = 1
  UNION ALL SELECT 4, r.* FROM ranked r WHERE kind <> 'district' AND EXISTS (SELECT 1 FROM places p WHERE p.kind = r.kind AND p.code = r.code AND p.region_code = 2)
  UNION ALL SELECT 5, r.* FROM ranked r WHERE kind = 'district'
), single AS (
  SELECT id, pass, rank, CASE WHEN pass = 3 THEN place ELSE -1 END AS name, max(kind) AS kind, max(code) AS code FROM readings GROUP BY 1, 2, 3, 4 HAVING count(*) = 1
), resolved AS (
  SELECT id, pass, kind, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, rank, name) AS n FROM single) WHERE n = 1
), located AS (
  SELECT r.id, r.pass, CASE WHEN r.kind = 'region' THEN r.code ELSE p.region_code END AS region_code, CASE WHEN r.kind = 'district' THEN r.code ELSE p.district_code END AS district_code, CASE WHEN r.kind = 'town' THEN r.code ELSE p.town_code END AS town_code,
         CASE WHEN r.kind = 'borough' THEN r.code ELSE p.borough_code END AS borough_code, CASE WHEN r.kind = 'quarter' THEN r.code END AS quarter_code, CASE WHEN r.kind = 'part' AND p.name_norm IS DISTINCT FROM p.town_norm THEN r.code END AS part_code, CASE WHEN r.kind = 'street' THEN r.code END AS street_code
  FROM resolved r JOIN places p ON p.kind = r.kind AND p.code = r.code
), here AS (
  SELECT l.id, f.name_place, f.form, f.nm, p.kind, p.code, p.borough_code, l.town_code, t.name_norm AS tnorm, d.name_norm AS dnorm
  FROM located l JOIN forms f ON f.id = l.id JOIN places p ON p.town_code = l.town_code AND p.name_norm = f.nm AND p.kind IN ('borough', 'quarter', 'part', 'street')
  LEFT JOIN places t ON t.kind = 'town' AND t.code = l.town_code LEFT JOIN places d ON d.kind = 'district' AND d.code = l.district_code
), here_borough AS (
  SELECT id, name_place, arg_min(code, form) AS code FROM here WHERE kind = 'borough' GROUP BY 1, 2
), here_quarter AS (
  SELECT id, name_place, CASE WHEN min(code) = max(code) THEN min(code) END AS code FROM here WHERE kind = 'quarter' AND NOT EXISTS (SELECT 1 FROM here_borough b WHERE b.id = here.id AND b.name_place = here.name_place) GROUP BY 1, 2
), here_named AS (
  SELECT DISTINCT id, 'borough' AS ukind, code AS ucode FROM here_borough UNION SELECT id, 'quarter', code FROM here_quarter WHERE code IS NOT NULL
), here_parts AS (
  SELECT DISTINCT id, name_place, kind, code, borough_code, NOT EXISTS (SELECT 1 FROM here_named n WHERE n.id = h.id AND NOT EXISTS (SELECT 1 FROM touched t WHERE t.kind = h.kind AND t.code = h.code AND t.ukind = n.ukind AND t.ucode = n.ucode)) AS fits
  FROM here h WHERE kind <> 'borough' AND nm IS DISTINCT FROM tnorm AND nm IS DISTINCT FROM dnorm AND NOT EXISTS (SELECT 1 FROM here_borough b WHERE b.id = h.id AND b.name_place = h.name_place)
), here_one AS (
  SELECT id, name_place, any_value(kind) AS kind, any_value(code) AS code, any_value(borough_code) AS borough_code FROM (
    SELECT *, bool_or(fits) OVER (PARTITION BY id, name_place) AS fitted FROM here_parts) WHERE fits OR NOT fitted GROUP BY 1, 2 HAVING count(*) = 1
), stating AS (
  SELECT id, kind, code FROM here_one UNION ALL SELECT id, 'borough', code FROM here_borough UNION ALL SELECT id, 'borough', borough_code FROM here_one WHERE kind = 'quarter' AND borough_code IS NOT NULL
), only_one AS (
  SELECT id, kind, min(code) AS code FROM stating GROUP BY 1, 2 HAVING min(code) = max(code)
), filled AS (
  SELECT l.id, l.pass, l.region_code, l.district_code, l.town_code, coalesce(l.borough_code, b.code) AS borough_code, coalesce(l.quarter_code, q.code) AS quarter_code, coalesce(l.part_code, p.code) AS part_code, coalesce(l.street_code, s.code) AS street_code
  FROM located l LEFT JOIN only_one b ON b.id = l.id AND b.kind = 'borough' LEFT JOIN only_one q ON q.id = l.id AND q.kind = 'quarter' LEFT JOIN only_one p ON p.id = l.id AND p.kind = 'part' LEFT JOIN only_one s ON s.id = l.id AND s.kind = 'street'
), with_part AS (
  SELECT f.* REPLACE (coalesce(f.part_code, x.part) AS part_code) FROM filled f LEFT JOIN (SELECT street, min(part) AS part FROM sp GROUP BY 1 HAVING min(part) = max(part)) x ON x.street = f.street_code
), holds AS (
  SELECT f.id, min(q.code) AS quarter FROM with_part f JOIN places q ON q.kind = 'quarter'
  WHERE f.quarter_code IS NULL AND (f.street_code IS NOT NULL OR f.part_code IS NOT NULL) AND (f.street_code IS NULL OR EXISTS (SELECT 1 FROM sq WHERE street = f.street_code AND quarter = q.code))
    AND (f.part_code IS NULL OR EXISTS (SELECT 1 FROM pq WHERE part = f.part_code AND quarter = q.code)) AND (f.borough_code IS NULL OR q.borough_code = f.borough_code)
  GROUP BY 1 HAVING count(DISTINCT q.code) = 1
), contained AS (
  SELECT f.* REPLACE (coalesce(f.quarter_code, h.quarter) AS quarter_code) FROM with_part f LEFT JOIN holds h USING (id)
), final AS (
  SELECT c.* REPLACE (coalesce(c.borough_code, q.borough_code) AS borough_code) FROM contained c LEFT JOIN places q ON q.kind = 'quarter' AND q.code = c.quarter_code
)
"""
CODES = ", ".join(f"CAST({k}_code AS BIGINT) AS {k}_code" for k in resolver.LOCATION)


def _within(register: resolver.Register) -> DataFrame:
    return register.places.where("region_code = 2").select("kind", "code")


def _resolved(spark, sf_dir):
    """The register, the kinds of listings, the listings of each, and what the kinds are resolved to."""
    register = register_of(spark, sf_dir)
    kinds, members = resolver.kinds_of(listings_of(spark, sf_dir))
    return register, kinds, members, resolver.resolved_of(kinds, register, _within(register))


@registered(CTE + "SELECT id, kind, code, name_norm FROM pool")
def resolve_pool(spark, sf_dir):
    return resolver.pool(listings_of(spark, sf_dir), register_of(spark, sf_dir).places).select("id", "kind", "code", "name_norm")


@registered(CTE + "SELECT id, kind, code, name_norm FROM pruned")
def contradiction_pruning(spark, sf_dir):
    register = register_of(spark, sf_dir)
    kinds, members = resolver.kinds_of(listings_of(spark, sf_dir))
    rows = resolver.without_contradictions(resolver.pool(kinds, register.places), kinds, register).select("id", "kind", "code", "name_norm")
    return resolver.of_members(rows, members)


@registered(CTE + "SELECT id, pass, kind, code FROM resolved")
def resolve_passes(spark, sf_dir):
    _, _, members, found = _resolved(spark, sf_dir)
    return resolver.of_members(found, members)


@registered(CTE + f"SELECT id, pass, {CODES} FROM located")
def location_parents(spark, sf_dir):
    register, _, members, found = _resolved(spark, sf_dir)
    return resolver.of_members(resolver.location_of(found, register.places), members)


@registered(CTE + f"SELECT id, pass, {CODES} FROM filled")
def names_inside_town(spark, sf_dir):
    register, kinds, members, found = _resolved(spark, sf_dir)
    return resolver.of_members(resolver.filled_from_names(resolver.location_of(found, register.places), kinds, register), members)


@registered(CTE + f"SELECT id, pass, {CODES} FROM final")
def locate_listings(spark, sf_dir):
    register = register_of(spark, sf_dir)
    return resolver.locate(listings_of(spark, sf_dir), register, _within(register))


@registered(CTE + "SELECT id, " + ", ".join(f"CASE WHEN g.name IS NOT NULL THEN {a}.name END AS {k}_name" for a, k in zip("gdtbqps", resolver.LOCATION)) + " FROM final f " + " ".join(f"LEFT JOIN places {a} ON {a}.kind = '{k}' AND {a}.code = f.{k}_code" for a, k in zip("gdtbqps", resolver.LOCATION)))
def location_names(spark, sf_dir):
    register = register_of(spark, sf_dir)
    return resolver.names_of(resolver.locate(listings_of(spark, sf_dir), register, _within(register)).drop("pass"), register.places)


@registered(CTE + """SELECT p.kind, p.code, CASE WHEN p.kind IN ('region', 'district', 'borough') THEN p.kind WHEN district_code IS NOT NULL THEN 'district' WHEN b.code IS NOT NULL THEN 'borough' ELSE 'region' END AS area_kind,
  CASE WHEN p.kind IN ('region', 'district', 'borough') THEN p.code WHEN district_code IS NOT NULL THEN district_code WHEN b.code IS NOT NULL THEN b.ucode ELSE region_code END AS area_code
  FROM places p LEFT JOIN (SELECT kind, code, min(ucode) AS ucode FROM touched WHERE ukind = 'borough' GROUP BY 1, 2 HAVING min(ucode) = max(ucode)) b ON b.kind = p.kind AND b.code = p.code""")
def search_area(spark, sf_dir):
    register = register_of(spark, sf_dir)
    return resolver.search_area(register.places, register)


@registered(CTE + """SELECT name_norm, string_agg(kind, ',' ORDER BY r) AS kinds FROM (SELECT DISTINCT name_norm, kind, CASE kind WHEN 'street' THEN 1 WHEN 'part' THEN 2 WHEN 'quarter' THEN 3 WHEN 'town' THEN 5 ELSE 6 END AS r
  FROM places WHERE kind IN ('street', 'part', 'quarter', 'town', 'district')) GROUP BY 1""")
def name_tiers(spark, sf_dir):
    return resolver.name_kinds(register_of(spark, sf_dir).places).select("name_norm", F.array_join("kinds", ",").alias("kinds"))


@registered(CTE + "SELECT p.kind, p.code, p.name, CASE WHEN p.kind <> 'town' THEN t.name END AS town_name, CASE WHEN p.kind <> 'district' THEN d.name END AS district_name FROM places p LEFT JOIN places t ON t.kind = 'town' AND t.code = p.town_code LEFT JOIN places d ON d.kind = 'district' AND d.code = p.district_code")
def named_place(spark, sf_dir):
    places = register_of(spark, sf_dir).places
    return resolver.named_places(places, places)
