"""Registered queries of field grammars, payload readers and the register's build."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import fields, geo, numbers, text
from larkspur.operators import criteria, profiles
from larkspur.plans.catalog import registered, table
from larkspur.sources import pages, payloads

C = F.col
NB = " "


@registered("SELECT p_partkey, CAST(1000 + p_partkey AS INTEGER) AS area, CAST(2000 + p_size AS INTEGER) AS plot, CAST(100 + p_size AS INTEGER) AS plain FROM part")
def grouped_areas(spark, sf_dir):
    group = lambda n: F.replace(F.format_number(n, 0), F.lit(","), F.lit(NB))
    p = table(spark, sf_dir, "part")
    house = F.concat(F.lit("Prodej domu "), group(1000 + C("p_partkey")), F.lit(f"{NB}m² s pozemkem "), group(2000 + C("p_size")), F.lit(f"{NB}m²"))
    flat = F.concat(F.lit("bytu 3+1 "), (100 + C("p_size")).cast("string"), F.lit(f"{NB}m²"))
    return p.select("p_partkey", fields.grouped_area(house).alias("area"), fields.grouped_plot(house).alias("plot"), fields.grouped_area(flat).alias("plain"))


@registered("""SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 50 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 0 END AS BIGINT) AS card, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size * 1000 AS BIGINT) END AS monthly FROM part""")
def portal_prices(spark, sf_dir):
    k, n = C("p_partkey") % 5, C("p_size").cast("string")
    said = F.when(k == 0, F.concat(n, F.lit(f"{NB}000 Kč"))).when(k == 1, F.concat(n, F.lit(" Kč (za m²)"))).when(k == 2, F.concat(n, F.lit(" 000 Kč (za rok)"))).when(k == 3, F.lit("Cena na vyžádání")).otherwise(F.lit("Pronajato"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.card_price(said, F.lit(50)).alias("card"), fields.monthly_price(said).alias("monthly"))


@registered("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1+kk' WHEN 1 THEN '5+1' WHEN 2 THEN 'garsoniéra' WHEN 3 THEN NULL WHEN 4 THEN 'DISP_9' END AS layout FROM part")
def layout_codes(spark, sf_dir):
    code = F.element_at(F.array(*(F.lit(x) for x in ("DISP_1_KK", "DISP_5_1", "GARSONIERA", "UNDEFINED", "DISP_9", ""))), (C("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.layout_of_code(code).alias("layout"))


@registered("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id + 1000000 AS BIGINT) END AS n FROM events")
def typed_numbers(spark, sf_dir):
    n = C("event_id") + 1_000_000
    grouped = F.format_number(n, 0)
    typed = F.when(C("event_id") % 4 == 0, grouped).when(C("event_id") % 4 == 1, F.replace(grouped, F.lit(","), F.lit(" "))).when(C("event_id") % 4 == 2, F.replace(grouped, F.lit(","), F.lit(NB))).otherwise(F.concat(grouped, F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", fields.typed_number(typed).alias("n"))


@registered("SELECT o_orderkey, o_totalprice > 1 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AS acceptable FROM orders")
def acceptable_rows(spark, sf_dir):
    ok = fields.acceptable(C("o_totalprice"), F.when(C("o_orderpriority") != "5-LOW", "CZK"), C("o_orderstatus") == "P", F.when(C("o_orderkey") % 7 != 0, C("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("acceptable"))


@registered("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Street|' || c_name WHEN 1 THEN 'Street 5/7|' || c_name WHEN 2 THEN 'Rybná|Praha 1' ELSE 'Street|Part|' || c_mktsegment END AS names,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN c_mktsegment END AS district, CASE WHEN c_custkey % 4 = 1 THEN '5' END AS number, CASE WHEN c_custkey % 4 = 1 THEN '7' END AS entrance
  FROM (SELECT c_custkey, 'Town' || chr(CAST(65 + c_custkey % 7 AS INTEGER)) AS c_name, c_mktsegment FROM customer)""")
def slot_addresses(spark, sf_dir):
    k, seg = C("c_custkey") % 4, C("c_mktsegment")
    town = F.concat(F.lit("Town"), F.chr(65 + C("c_custkey") % 7))
    said = F.when(k == 0, F.concat(F.lit("Street , "), seg, F.lit(", Kraj Vysočina"))).when(k == 1, F.concat(F.lit("Street 5/7, "), seg, F.lit(", Plzeňský kraj"))).when(k == 2, F.lit("Rybná , Hlavní město Praha , Praha 1, Hlavní město Praha")).otherwise(F.concat(F.lit("Street - Part, "), seg, F.lit(", Plzeňský kraj")))
    heading = F.when(k < 2, F.concat(F.lit("Prodej bytu 60 m², "), town)).when(k == 2, F.lit("Prodej bytu")).otherwise(F.concat(F.lit("Prodej, "), seg))
    at = fields.slot_address(said, heading)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(at["names"], "|").alias("names"), at["district"].alias("district"), at["number"].alias("number"), at["entrance"].alias("entrance"))


@registered("SELECT c_custkey, nullif(concat_ws(' - ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END), '') AS title, replace(lower(c_name), '#', '#') AS slug FROM customer")
def composed_titles(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fields.composed(" - ", F.when(C("c_custkey") % 2 == 0, C("c_name")).otherwise(F.lit("")), F.when(C("c_custkey") % 3 == 0, C("c_mktsegment"))).alias("title"), text.slug(C("c_name")).alias("slug"))


@registered("SELECT page_id, i - 1 AS place, regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(<li\\b[^>]*>.*?</li>)', 1)) AS c, generate_subscripts(regexp_extract_all(html, '(?s)(<li\\b[^>]*>.*?</li>)', 1), 1) AS i FROM pages)")
def page_cards(spark, sf_dir):
    rows = payloads.cards(table(spark, sf_dir, "pages"), "html", "li", ("data-id",), "page_id")
    return rows.select("page_id", C("place").cast("long").alias("place"), F.concat(F.lit(" "), C("text"), F.when(C("text") != "", " ").otherwise("")).alias("text"))


@registered("SELECT page_id, CAST(len(list_distinct(u)) AS BIGINT) AS n, coalesce(u[1], '') AS first FROM (SELECT page_id, list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: x <> '') AS u FROM pages)")
def page_gallery(spark, sf_dir):
    urls = payloads.gallery(C("html"), 'href="([^"]*)"')
    return table(spark, sf_dir, "pages").select("page_id", F.size(urls).cast("long").alias("n"), F.coalesce(F.try_element_at(urls, F.lit(1)), F.lit("")).alias("first"))


@registered("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%.example.net' AND regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) NOT LIKE '/en/%' AS allowed FROM pages")
def allowed_urls(spark, sf_dir):
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, sf_dir, "pages").select("page_id", (host.endswith(".example.net") & pages.allowed_url(C("url"), host, "/en/")).alias("allowed"))


@registered("SELECT o_orderkey, 'c' || o_custkey AS customer, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def followed_references(spark, sf_dir):
    """Orders and customers as entries of one cache, orders referring to customers, a third of which are missing."""
    quoted = lambda **kv: F.to_json(F.struct(*(v.alias(k) for k, v in kv.items())))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), C("o_orderkey").cast("string")).alias("key"), quoted(customer=F.struct(F.concat(F.lit("c"), C("o_custkey").cast("string")).alias("__ref"))).alias("value"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), C("c_custkey").cast("string")).alias("key"), quoted(name=C("c_name")).alias("value"))
    json = o.union(c).select(F.lit(1).alias("page"), F.to_json(F.create_map("key", "value")).alias("json"))
    found = payloads.followed(payloads.cache_entries(json, "json", "page"), "customer", "page").where(C("key").startswith("o"))
    return found.select(F.substring("key", F.lit(2), F.char_length("key")).cast("long").alias("o_orderkey"), F.get_json_object(C("fields")["customer"], "$.__ref").alias("customer"), C("target")["name"].alias("name"))


@registered("SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS l_linestatus, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY 1")
def agreed_copies(spark, sf_dir):
    return payloads.agreed(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus")


@registered("""WITH a AS (SELECT 'n' || n_nationkey // 2 AS name_norm, min(n_nationkey) AS code, count(*) AS a FROM nation GROUP BY 1), b AS (SELECT 'n' || c_nationkey % 15 AS name_norm, min(c_nationkey) AS portal_id, count(*) AS b FROM (SELECT DISTINCT c_nationkey FROM customer) GROUP BY 1)
  SELECT coalesce(a.name_norm, b.name_norm) AS name_norm, CAST(code AS BIGINT) AS code, CAST(portal_id AS BIGINT) AS portal_id, CASE WHEN a > 1 OR b > 1 THEN 'ambiguous' WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unknown' END AS problem FROM a FULL JOIN b ON a.name_norm = b.name_norm""")
def harvested_names(spark, sf_dir):
    official = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.floor(C("n_nationkey") / 2).cast("string")).alias("name_norm"), C("n_nationkey").cast("long").alias("code"))
    portal = table(spark, sf_dir, "customer").select("c_nationkey").distinct().select(F.concat(F.lit("n"), (C("c_nationkey") % 15).cast("string")).alias("name_norm"), C("c_nationkey").cast("long").alias("portal_id"))
    return payloads.matched_names(official, portal)


@registered("SELECT l_suppkey AS street, round(avg(l_quantity), 6) AS y, round(avg(l_linenumber), 6) AS x FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 6 <> 0 GROUP BY 1")
def street_centres(spark, sf_dir):
    here = F.when(C("l_returnflag") != "R", C("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.when(C("l_suppkey") % 6 != 0, C("l_suppkey")).alias("street"), here.alias("y"), C("l_linenumber").cast("double").alias("x"))
    return payloads.street_centres(rows).select("street", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


@registered("SELECT DISTINCT l_suppkey AS street, l_partkey AS part FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F')")
def overlap_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("street"), C("l_partkey").alias("part"), F.when((C("l_returnflag") == "A") & (C("l_linestatus") == "F"), 1.0).alias("x"), F.lit(1.0).alias("y"))
    return payloads.overlaps(rows, "street", "part", payloads.street_centres(rows))


@registered("""SELECT 'nations' AS rule, count(*) AS found, count(*) BETWEEN 20 AND 30 AS ok FROM nation UNION ALL SELECT 'customers', count(*), count(*) BETWEEN 1 AND 10 FROM customer
  UNION ALL SELECT 'regions of nations', count(*), count(*) = 0 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'orders of customers', count(*), count(*) = 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def register_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return payloads.verified({"nations": (t("nation"), 20, 30), "customers": (t("customer"), 1, 10)}, {"regions of nations": (t("nation"), "n_regionkey", t("region"), "r_regionkey"), "orders of customers": (t("customer"), "c_custkey", t("orders"), "o_custkey")})


@registered("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 25 = 3 OR c_nationkey = 7 ELSE false END AS preferred, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_nationkey = 7 END, false) AS inside FROM customer")
def preferred_places(spark, sf_dir):
    known = C("c_custkey") % 5 > 0
    at = {"town": F.when(known, C("c_custkey") % 25), "district": F.when(known, C("c_nationkey"))}
    wanted = F.array(F.struct(F.lit("town").alias("kind"), F.lit(3).alias("code")), F.struct(F.lit("district").alias("kind"), F.lit(7).alias("code")))
    rows = table(spark, sf_dir, "customer").withColumn("district", at["district"])
    return rows.select("c_custkey", profiles.in_preferred(at, wanted).alias("preferred"), criteria.inside_place("district", 7, {"district": "district"}).alias("inside"))


@registered("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, c_mktsegment || ' ' || c_custkey) || ' (' || concat_ws(', ', c_mktsegment, n_name) || ')' AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def place_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0"), C("c_nationkey") == C("n_nationkey"), "left")
    return rows.select("c_custkey", profiles.place_label(F.when(C("c_custkey") % 3 > 0, C("c_name")), C("c_mktsegment"), C("c_custkey"), C("n_name"), F.lit(None).cast("string")).alias("label"))


@registered("""SELECT round(min(lat) - m, 6) AS south, round(max(lat) + m, 6) AS north, round(min(lon) - m / cos(radians((min(lat) + max(lat)) / 2)), 6) AS west, round(max(lon) + m / cos(radians((min(lat) + max(lat)) / 2)), 6) AS east
  FROM (SELECT 48.5 + c_custkey % 211 * 0.01 AS lat, 12.1 + c_custkey % 331 * 0.02 AS lon, 500 / (6371000.0 * pi() / 180) AS m FROM customer) GROUP BY m""")
def bounding_boxes(spark, sf_dir):
    at = table(spark, sf_dir, "customer").select((48.5 + C("c_custkey") % 211 * 0.01).alias("lat"), (12.1 + C("c_custkey") % 331 * 0.02).alias("lon"))
    return at.agg(geo.bounding_box(C("lat"), C("lon"), 500.0).alias("b")).select(*(F.round(C(f"b.{k}"), 6).alias(k) for k in ("south", "north", "west", "east")))


@registered("SELECT p_partkey, CASE WHEN p_size <> 13 AND p_size > 0 THEN round(p_retailprice / p_size, 6) END AS per_m2 FROM part")
def price_per_area(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.price_per_m2(C("p_retailprice"), F.nullif(C("p_size"), F.lit(13))), 6).alias("per_m2"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'street' WHEN c_custkey % 2 = 0 THEN 'town' ELSE 'region' END AS kind, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 1 END AS BIGINT) AS code FROM customer")
def finest_units(spark, sf_dir):
    k = C("c_custkey")
    unit = fields.finest({"street": F.when(k % 3 == 0, k.cast("long")), "town": F.when(k % 2 == 0, C("c_nationkey").cast("long")), "region": F.lit(1).cast("long")})
    return table(spark, sf_dir, "customer").select("c_custkey", unit["kind"].alias("kind"), unit["code"].alias("code"))
