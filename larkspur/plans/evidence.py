"""Registered queries of what linkage and tracking go by: places and names of records, audit records, refinement, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import linkage, profiles, register, tracking
from larkspur.plans.catalog import registered, table

C = F.col


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 50.0 + c_custkey % 7 WHEN c_custkey % 3 = 1 THEN 40.0 + c_nationkey END AS lat, CASE WHEN c_custkey % 3 = 0 THEN 14.0 WHEN c_custkey % 3 = 1 THEN 15.0 END AS lon, CASE WHEN c_custkey % 3 = 0 THEN 'gps' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'street' ELSE 'town' END END AS tier FROM customer""")
def place_evidence(spark, sf_dir):
    """Where a record is: by its own position, else by its finest unit, else nowhere."""
    k, kind = C("c_custkey") % 3, F.when(C("c_nationkey") % 2 == 0, "street").otherwise("town")
    at = linkage.place_evidence(F.when(k == 0, 50.0 + C("c_custkey") % 7), F.when(k < 2, 14.0), 40.0 + C("c_nationkey"), F.lit(15.0), F.when(k < 2, kind))
    return table(spark, sf_dir, "customer").select("c_custkey", at.alias("at")).select("c_custkey", "at.*")


# suppliers as streets, parts, quarters and towns of names that repeat, within the town of their nation
UNITS = "SELECT ['street', 'part', 'quarter', 'town', 'region'][1 + s_suppkey % 5] AS kind, 1 + s_suppkey % 5 AS rank, 'n' || s_suppkey % 30 AS name_norm, 't' || s_nationkey AS town_norm FROM supplier"


@registered(f"""WITH u AS ({UNITS}), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN 't' || c_nationkey END AS town, unnest(['n' || c_custkey % 30, 'n' || c_custkey % 37]) AS name FROM customer),
  f AS (SELECT id, name, max(rank) AS rank FROM a JOIN u ON name = name_norm AND (town IS NULL OR town = town_norm) WHERE rank < 5 GROUP BY 1, 2)
  SELECT CAST(id AS BIGINT) AS id, string_agg(name || ' ' || ['gps', 'street', 'part', 'quarter', 'town'][rank + 1], ',' ORDER BY name) AS names FROM f GROUP BY 1""")
def listing_name_tiers(spark, sf_dir):
    """How exact each name of a record is: the coarsest unit of its town that carries it, or of any where the town isn't known."""
    s = C("s_suppkey")
    kinds = F.array(*(F.lit(x) for x in ("street", "part", "quarter", "town", "region")))
    places = table(spark, sf_dir, "supplier").select(F.element_at(kinds, (1 + s % 5).cast("int")).alias("kind"), F.concat(F.lit("n"), s % 30).alias("name_norm"), F.concat(F.lit("t"), "s_nationkey").alias("town_norm"))
    k = C("c_custkey")
    listings = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), F.array(F.concat(F.lit("n"), k % 30), F.concat(F.lit("n"), k % 37)).alias("names"), F.when(k % 4 > 0, F.concat(F.lit("t"), "c_nationkey")).alias("town_norm"))
    found = linkage.name_tiers(listings, places)
    return found.select("id", F.array_join(F.transform("names", lambda n: F.concat_ws(" ", n["name"], n["tier"])), ",").alias("names"))


@registered("""SELECT p_partkey, '{"total":' || printf('%.1f', p_size * 0.5) || ',"band":"' || CASE WHEN p_size > 25 THEN 'match' ELSE 'uncertain' END || '","factors":[{"name":"price","contribution":' || printf('%.1f', p_size * 0.5) || CASE WHEN p_size % 2 = 0 THEN ',"evidence":"' || p_size || ' apart"' ELSE '' END || '},{"name":"layout","contribution":0.0,"evidence":"same"}]}' AS record FROM part""")
def pair_audit(spark, sf_dir):
    """The audit record of a scored pair as JSON; a factor without evidence leaves it out."""
    points, n = C("p_size") * 0.5, C("p_size")
    said = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(" apart")))
    record = linkage.evidence_json(points, F.when(n > 25, "match").otherwise("uncertain"), {"price": (points, said), "layout": (F.lit(0.0), F.lit("same"))})
    return table(spark, sf_dir, "part").select("p_partkey", record.alias("record"))


@registered("""SELECT l_orderkey, l_linenumber, l_suppkey % 5 < l_partkey % 5 OR l_suppkey % 5 = l_partkey % 5 AND l_linenumber % 2 = 0 AND l_orderkey % 3 = 0 AS finer FROM lineitem""")
def location_refined(spark, sf_dir):
    """Whether a new location is more exact than the stored one."""
    house = lambda test: F.when(test, F.lit("12"))
    finer = register.refined(C("l_partkey") % 5, house(C("l_orderkey") % 3 != 0), C("l_suppkey") % 5, house(C("l_linenumber") % 2 == 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", finer.alias("finer"))


@registered("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'posted' ELSE 'price_change' END AS kind FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 200000""")
def changes_since(spark, sf_dir):
    """Postings and price changes after a time; other events and earlier ones don't count."""
    kind = F.when(C("o_orderstatus") == "O", "posted").when(C("o_orderstatus") == "F", "price_change").otherwise("viewed")
    events = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), C("o_totalprice").alias("at"))
    return tracking.changes_since(events, F.lit(200000)).select("o_orderkey", "kind")


@registered("""SELECT c_custkey, widened FROM (SELECT c_custkey, true AS widened, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey = 3 END AS inside FROM customer) WHERE inside UNION ALL SELECT c_custkey, false FROM customer""")
def inside_widened_area(spark, sf_dir):
    """Records inside the place where a wider area was searched for it; all of them where the area is the place."""
    rows = table(spark, sf_dir, "customer")
    inside = F.when(C("c_custkey") % 5 > 0, C("c_nationkey") == 3)
    of = lambda area: profiles.inside_where_widened(rows, ("ward", 3), area, inside)
    return of(("town", 1)).select("c_custkey", F.lit(True).alias("widened")).unionByName(of(("ward", 3)).select("c_custkey", F.lit(False).alias("widened")))
