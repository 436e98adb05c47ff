"""The registered queries: each operator on whole tables, with the SQL that gives the same rows.

Roles of the tables: events is the log of observations (user_id an item, value in steps of 25 its price), part holds items,
orders of a customer are what a profile tracks, region, nation, customer and supplier are places, lineitem is a bridge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import geo, numbers, text
from larkspur.operators import criteria, history, linkage, ranking, register, state
from larkspur.sources import pages
from larkspur.streaming import scans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("seen_at"), F.col("event_id").alias("id"), F.floor(F.col("value") / 25).cast("long").alias("price"))


LOG = "(SELECT user_id AS item, ts AS seen_at, event_id AS id, CAST(floor(value / 25) AS BIGINT) AS price FROM events)"
RUNS = f"""(SELECT item, run, any_value(price) AS price, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM (
  SELECT *, CAST(sum(c) OVER (PARTITION BY item ORDER BY seen_at, id) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN lag(price) OVER w = price THEN 0 ELSE 1 END AS c FROM {LOG} WINDOW w AS (PARTITION BY item ORDER BY seen_at, id)))
  GROUP BY item, run)"""
KEYS = ("item", "seen_at", "id", "price")


# -- price history ---------------------------------------------------------------------------------------------------


@registered(f"SELECT item, max(seen_at) AS seen_at, arg_max(price, (seen_at, id)) AS price FROM {LOG} GROUP BY item")
def latest_price(spark, sf_dir):
    return history.latest(observations(spark, sf_dir), *KEYS)


PREVIOUS = f"""(SELECT l.item, l.price, arg_max(o.price, (o.seen_at, o.id)) AS previous FROM (SELECT item, arg_max(price, (seen_at, id)) AS price FROM {LOG} GROUP BY item) l
  LEFT JOIN {LOG} o ON o.item = l.item AND o.price <> l.price GROUP BY l.item, l.price)"""


@registered(f"SELECT item, price, previous FROM {PREVIOUS}")
def previous_different_price(spark, sf_dir):
    return history.previous_different(observations(spark, sf_dir), *KEYS)


@registered(f"SELECT item, price, CASE WHEN previous > price THEN previous END AS drop_from FROM {PREVIOUS}")
def price_drop_flag(spark, sf_dir):
    return history.with_drop(history.previous_different(observations(spark, sf_dir), *KEYS), "price").select("item", "price", "drop_from")


@registered(f"SELECT item, run, price, first_seen_at, last_seen_at FROM {RUNS}")
def price_runs(spark, sf_dir):
    return history.price_runs(observations(spark, sf_dir), *KEYS)


@registered(f"SELECT item, seen_at, price_from, price_to FROM (SELECT item, run, first_seen_at AS seen_at, lag(price) OVER (PARTITION BY item ORDER BY run) AS price_from, price AS price_to FROM {RUNS}) WHERE run > 1")
def price_change_pairs(spark, sf_dir):
    return history.price_changes(history.price_runs(observations(spark, sf_dir), *KEYS), "item", "price")


@registered(f"SELECT item, run, price, coalesce(lead(first_seen_at) OVER (PARTITION BY item ORDER BY run), last_seen_at) AS held_until FROM {RUNS}")
def held_until(spark, sf_dir):
    return history.held_until(history.price_runs(observations(spark, sf_dir), *KEYS), "item").select("item", "run", "price", "held_until")


@registered(f"SELECT item, min(price) AS low, max(price) AS high, min(first_seen_at) AS since, max(last_seen_at) AS until FROM {RUNS} GROUP BY item")
def chart_extent(spark, sf_dir):
    return history.chart_extent(history.price_runs(observations(spark, sf_dir), *KEYS), "item", "price")


@registered(f"""SELECT m.id, m.item, m.seen_at, o.price AS as_of_price FROM (SELECT event_id AS id, user_id AS item, ts AS seen_at FROM events WHERE event_type = 'view') m
  ASOF LEFT JOIN (SELECT item, seen_at, price FROM {LOG} l JOIN (SELECT event_id, event_type FROM events) e ON e.event_id = l.id WHERE event_type <> 'view') o ON o.item = m.item AND o.seen_at <= m.seen_at""")
def asof_price(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = events.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), F.col("ts").alias("seen_at"))
    log = events.where("event_type <> 'view'").select(F.col("user_id").alias("item"), F.col("ts").alias("seen_at"), F.col("event_id").alias("id"), F.floor(F.col("value") / 25).cast("long").alias("price"))
    return history.as_of(seen, log, "item", "seen_at", "seen_at", "id", "price")


@registered(f"""SELECT item, kind, seen_at, price_from, price_to, row_number() OVER (PARTITION BY item ORDER BY seen_at DESC, o) AS place FROM (
  SELECT item, 'found' AS kind, min(seen_at) AS seen_at, NULL::BIGINT AS price_from, NULL::BIGINT AS price_to, 0 AS o FROM {LOG} GROUP BY item
  UNION ALL SELECT item, 'price_change', first_seen_at, p, price, 1 FROM (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY run) AS p FROM {RUNS}) WHERE run > 1)""")
def event_history(spark, sf_dir):
    log = observations(spark, sf_dir)
    return history.event_history(history.price_changes(history.price_runs(log, *KEYS), "item", "price"), log.groupBy("item").agg(F.min("seen_at").alias("seen_at")), "item", "seen_at")


@registered(f"SELECT item, count(*) AS n_changes, string_agg(CAST(price AS VARCHAR), '>' ORDER BY run) AS series FROM {RUNS} GROUP BY item")
def nested_price_runs(spark, sf_dir):
    nested = history.nested_runs(history.price_runs(observations(spark, sf_dir), *KEYS), "item", "price")
    return nested.select("item", F.size("changes").cast("long").alias("n_changes"), F.array_join(F.transform("changes", lambda c: c["price"].cast("string")), ">").alias("series"))


# -- state -----------------------------------------------------------------------------------------------------------


@registered("SELECT DISTINCT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def viewed_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@registered("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def untracked_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@registered("""SELECT coalesce(b.item, n.item) AS item, CASE WHEN b.item IS NULL THEN 'new' WHEN n.item IS NULL THEN 'missing' WHEN b.p > n.p AND n.p > 0 THEN 'dropped' WHEN b.p = n.p THEN 'same' ELSE 'changed' END AS state,
  b.p AS price_before, n.p AS price_now
  FROM (SELECT o_custkey AS item, CAST(floor(max(o_totalprice) / 1000) AS BIGINT) AS p FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) b
  FULL JOIN (SELECT o_custkey AS item, CAST(floor(max(o_totalprice) / 1000) AS BIGINT) AS p FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) n ON b.item = n.item""")
def snapshot_diff(spark, sf_dir):
    scan = lambda y: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("item")).agg(F.floor(F.max("o_totalprice") / 1000).cast("long").alias("price"))
    return state.snapshot_diff(scan(1996), scan(1997), "item", "price")


@registered("SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) AS seen FROM orders GROUP BY o_custkey")
def first_last_seen(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.count("*").alias("seen"))


@registered("""WITH s AS (SELECT o_custkey AS item, month(o_orderdate) AS m FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) <= 6)
  SELECT item, CAST(make_timestamp(1998, min(m), 1, 0, 0, 0.0) AS TIMESTAMP) AS first_seen, CAST(make_timestamp(1998, max(m), 1, 0, 0, 0.0) AS TIMESTAMP) AS last_seen, CAST(6 - max(m) AS BIGINT) AS misses FROM s GROUP BY item""")
def miss_counter(spark, sf_dir):
    """Tracking after the six monthly scans of half a year."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1998)
    tracking = spark.createDataFrame([], "item long, first_seen timestamp_ntz, last_seen timestamp_ntz, misses long")
    for m in range(1, 7):
        scan = orders.where(F.month("o_orderdate") == m).select(F.col("o_custkey").alias("item"))
        tracking = state.advance_tracking(tracking, scan, "item", F.lit(f"1998-{m:02d}-01").cast("timestamp_ntz"))
    return tracking


@registered("""WITH t AS (SELECT o_custkey AS item, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1)
  SELECT item, first_seen, last_seen FROM t WHERE NOT (last_seen < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AND item NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def ttl_prune(spark, sf_dir):
    tracking = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    favourites = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("item"))
    return state.prune(tracking, favourites, "item", F.lit("2001-08-01").cast("timestamp_ntz"))


@registered("""SELECT o_orderstatus AS profile, CASE WHEN o_custkey % 3 = 1 THEN o_custkey - 1 ELSE o_custkey END AS winner, min(o_orderkey) AS index, min(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END) AS viewed_at,
  min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS favourited_at, max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate END) AS updated_at FROM orders GROUP BY 1, 2""")
def fold_tracking(spark, sf_dir):
    when = lambda p: F.when(F.col("o_orderpriority") == p, F.col("o_orderdate"))
    orders = table(spark, sf_dir, "orders")
    tracking = orders.select(F.col("o_orderstatus").alias("profile"), F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("index"), when("5-LOW").alias("viewed_at"), when("1-URGENT").alias("favourited_at"), when("2-HIGH").alias("updated_at"))
    merged = orders.where("o_custkey % 3 = 1").select(F.col("o_custkey").alias("loser"), (F.col("o_custkey") - 1).alias("winner")).distinct()
    return state.fold_tracking(tracking, merged, "item", "profile")


@registered("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS new, count(*) FILTER (o_orderpriority = '1-URGENT') AS updated, count(*) FILTER (o_totalprice < 1000) AS price_drops FROM orders")
def run_counts(spark, sf_dir):
    return state.run_counts(table(spark, sf_dir, "orders"), new=F.col("o_orderstatus") == "O", updated=F.col("o_orderpriority") == "1-URGENT", price_drops=F.col("o_totalprice") < 1000)


@registered("""SELECT source, count(d.doc_id) AS found, CASE WHEN count(d.doc_id) = 0 THEN 'zero_results' ELSE 'ok' END AS health
  FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'silent') s LEFT JOIN documents d USING (source) GROUP BY source""")
def source_health(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    enabled = docs.select("source").distinct().union(spark.createDataFrame([("silent",)], "source string"))
    return state.source_health(docs, enabled, "source")


@registered("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS index FROM orders""")
def running_index(spark, sf_dir):
    return ranking.running_index(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "index")


@registered("""SELECT o_custkey, l_orderkey AS o_orderkey, n_photos FROM (SELECT o_custkey, o_orderkey AS l_orderkey, n_photos, row_number() OVER (PARTITION BY o_custkey ORDER BY n_photos DESC, o_orderkey) AS n
  FROM (SELECT o_custkey, o_orderkey, count(l_linenumber) AS n_photos FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE n = 1""")
def gallery_pick(spark, sf_dir):
    photos = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n_photos"))
    counted = table(spark, sf_dir, "orders").join(photos, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("n_photos", F.lit(0)).cast("long").alias("n_photos"))
    return ranking.budget_per_group(counted, "o_custkey", 1, F.desc("n_photos"), F.asc("o_orderkey")).drop("rank")


# -- places ----------------------------------------------------------------------------------------------------------


@registered("""SELECT 'region' AS kind, CAST(r_regionkey AS BIGINT) AS code, r_name AS name, NULL::BIGINT AS nation_code, NULL::BIGINT AS region_code FROM region
  UNION ALL SELECT 'nation', n_nationkey, n_name, NULL, n_regionkey FROM nation
  UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, n_regionkey FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def hierarchy_union_view(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_code"), F.col("n_regionkey").cast("long").alias("region_code"), "n_name")
    leaf = lambda kind, t, p: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(f"{p}_{t[:4]}key").alias("code"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").cast("long").alias("nation_code")).join(nation.drop("n_name"), "nation_code", "left").select("kind", "code", "name", "nation_code", "region_code")
    none = F.lit(None).cast("long")
    top = table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("code"), F.col("r_name").alias("name"))
    middle = nation.select(F.lit("nation").alias("kind"), F.col("nation_code").alias("code"), F.col("n_name").alias("name"), none.alias("nation_code"), "region_code")
    return register.hierarchy(middle, top, leaf("customer", "customer", "c"), leaf("supplier", "supplier", "s"))


@registered("SELECT l_partkey, s_nationkey, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def bridge_touch_set(spark, sf_dir):
    pairs = register.touching(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return pairs.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey", "s_nationkey").agg(F.count("*").alias("n"))


@registered("SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN max(l_suppkey) END AS only_supplier FROM lineitem GROUP BY l_orderkey")
def unique_or_null_parent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(register.only(F.col("l_suppkey")).alias("only_supplier"))


@registered("SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def relational_division(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return register.touching_all(items, "l_suppkey", "l_returnflag", items.select("l_returnflag"))


SEARCH = """(SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS code, n_name AS name FROM nation UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)"""


def _places(spark, sf_dir):
    one = lambda k, t, c, n: table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).cast("long").alias("code"), F.col(n).alias("name"))
    out = register.hierarchy(one("nation", "nation", "n_nationkey", "n_name"), one("customer", "customer", "c_custkey", "c_name"), one("supplier", "supplier", "s_suppkey", "s_name"))
    return out.withColumn("name_norm", text.normalize_name(F.col("name")))


@registered(f"""SELECT kind, code, name, row_number() OVER (ORDER BY k, lower(name), name, code) AS rank FROM (
  SELECT *, CASE kind WHEN 'nation' THEN 0 WHEN 'supplier' THEN 1 ELSE 2 END AS k FROM {SEARCH} WHERE starts_with(lower(name), 'su') OR starts_with(lower(name), 'na') AND false) ORDER BY rank LIMIT 20""")
def prefix_search_topk(spark, sf_dir):
    return register.search(_places(spark, sf_dir), "su", {"nation": 0, "supplier": 1, "customer": 2}).select("kind", "code", "name", "rank")


@registered("""WITH c AS (SELECT l_orderkey AS id, 1 AS pass, 1 AS kind_rank, l_suppkey AS code FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_orderkey, 1, 2, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 2, 1, l_suppkey FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, 3, 2, l_partkey FROM lineitem),
  s AS (SELECT id, pass, kind_rank, max(code) AS code FROM c GROUP BY ALL HAVING count(DISTINCT code) = 1)
  SELECT id, arg_min(kind_rank, (pass, kind_rank)) AS kind_rank, arg_min(code, (pass, kind_rank)) AS code, min(pass) AS pass FROM s GROUP BY id""")
def resolve_ladder(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    row = lambda test, p, k, c: items.where(test).select(F.col("l_orderkey").alias("id"), F.lit(p).alias("pass"), F.lit(k).alias("kind_rank"), F.col(c).alias("code"))
    rows = register.hierarchy(row("l_returnflag = 'R'", 1, 1, "l_suppkey"), row("l_returnflag = 'R'", 1, 2, "l_partkey"), row("l_linestatus = 'O'", 2, 1, "l_suppkey"), row("true", 3, 2, "l_partkey"))
    return register.resolve(rows, "id")


@registered("SELECT c_custkey, CASE WHEN n_name = c_mktsegment OR n_name = r_name THEN concat_ws(', ', c_mktsegment, r_name) ELSE concat_ws(', ', c_mktsegment, n_name) END AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def display_place(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", text.display_place(F.col("c_mktsegment"), F.col("n_name"), F.col("r_name")).alias("place"))


CELLS = "SELECT {p}_{k} AS id, CAST(floor(({p}_{k} % 97) * 0.005 / 0.0108) AS BIGINT) AS cx, CAST(floor(({p}_{k} % 89) * 0.007 / 0.0168) AS BIGINT) AS cy FROM {t}"


@registered(f"SELECT c.id AS c_id, s.id AS s_id FROM ({CELLS.format(p='c', k='custkey', t='customer')}) c JOIN ({CELLS.format(p='s', k='suppkey', t='supplier')}) s ON abs(c.cx - s.cx) <= 1 AND abs(c.cy - s.cy) <= 1")
def band_neighbours(spark, sf_dir):
    at = lambda k: geo.cell((F.col(k) % 97) * 0.005, (F.col(k) % 89) * 0.007)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_id"), at("c_custkey").alias("cell"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s_id"), F.explode(geo.neighbour_cells(at("s_suppkey"))).alias("cell"))
    return c.join(s, "cell").select("c_id", "s_id")


H = "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"


@registered(f"SELECT c_custkey, CAST(floor(lat / 0.0108) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.0168) AS BIGINT) AS cell_lon, CAST(round_even(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0) AS BIGINT) AS metres FROM (SELECT *, {H.format(a='', b='o')} AS h FROM (SELECT c_custkey, 48.5 + (c_custkey % 211) * 0.01 AS lat, 12.1 + (c_custkey % 331) * 0.02 AS lon, 50.08 AS olat, 14.43 AS olon FROM customer))")
def haversine_cells(spark, sf_dir):
    at = table(spark, sf_dir, "customer").select("c_custkey", (48.5 + (F.col("c_custkey") % 211) * 0.01).alias("lat"), (12.1 + (F.col("c_custkey") % 331) * 0.02).alias("lon"))
    cell = geo.cell(F.col("lat"), F.col("lon"))
    return at.select("c_custkey", cell["lat"].alias("cell_lat"), cell["lon"].alias("cell_lon"), geo.metres(F.col("lat"), F.col("lon"), F.lit(50.08), F.lit(14.43)).alias("metres"))


@registered(f"""SELECT c_custkey, CAST(arg_min(k, (d, k)) AS BIGINT) AS n_nationkey, round(min(d), 3) AS metres FROM (SELECT c_custkey, k, round(2 * 6371000.0 * asin(sqrt({H.format(a='', b='o')})), 6) AS d FROM
  (SELECT c_custkey, 48.5 + (c_custkey % 211) * 0.01 AS lat, 12.1 + (c_custkey % 331) * 0.02 AS lon FROM customer), (SELECT n_nationkey AS k, 48.6 + n_nationkey * 0.083 AS olat, 12.2 + (n_nationkey * 7 % 25) * 0.26 AS olon FROM nation)) GROUP BY c_custkey""")
def nearest_poi(spark, sf_dir):
    """The nearest of a short, fixed list of points: the list goes to every row, and one pass takes the least."""
    at = table(spark, sf_dir, "customer").select("c_custkey", (48.5 + (F.col("c_custkey") % 211) * 0.01).alias("lat"), (12.1 + (F.col("c_custkey") % 331) * 0.02).alias("lon"))
    points = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(48.6 + k * 0.083).alias("lat"), F.lit(12.2 + (k * 7 % 25) * 0.26).alias("lon")) for k in range(25)))
    away = F.transform(points, lambda p: F.struct(F.round(geo.distance(F.col("lat"), F.col("lon"), p["lat"], p["lon"]), 6).alias("d"), p["k"].alias("k")))
    return at.withColumn("best", F.array_min(away)).select("c_custkey", F.col("best.k").alias("n_nationkey"), F.round("best.d", 3).alias("metres"))


# -- filters, ranking ------------------------------------------------------------------------------------------------

PARTS = "(SELECT p_partkey, p_brand, nullif(p_type, 'PROMO') AS layout, nullif(p_size, 13) AS size, p_retailprice AS price FROM part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("layout"), F.nullif(F.col("p_size"), F.lit(13)).alias("size"), F.col("p_retailprice").alias("price"))


@registered(f"SELECT p_partkey, layout, size, price FROM {PARTS} WHERE (size IS NULL OR size BETWEEN 10 AND 30) AND (layout IS NULL OR layout IN ('ECONOMY', 'SMALL')) AND price <= 950")
def criteria_null_passes(spark, sf_dir):
    return criteria.apply_criteria(_parts(spark, sf_dir), {"size": (10, 30), "price": (None, 950)}, ["ECONOMY", "SMALL"], "layout").drop("p_brand")


@registered(f"SELECT p_partkey, layout, size, price FROM {PARTS} WHERE size BETWEEN 10 AND 30 AND layout IN ('ECONOMY', 'SMALL') AND price <= 950")
def filter_null_fails(spark, sf_dir):
    return criteria.apply_filter(_parts(spark, sf_dir), {"size": (10, 30), "price": (None, 950)}, {"layout": ["ECONOMY", "SMALL"]}).drop("p_brand")


@registered(f"""SELECT p_partkey, CAST(round_even(CASE WHEN layout IS NULL THEN 0 WHEN layout = 'ECONOMY' THEN 0.25 * 100.0 ELSE 0 END + CASE WHEN size IS NULL THEN 0 ELSE 0.35 * least(100.0, size / 40.0 * 100) END
  + 0.1 * CASE WHEN p_brand = 'Brand#2' THEN 100.0 ELSE 0.0 END + 0.3 * greatest(0.0, least(100.0, (2 - price / 930.0) * 100)), 0) AS BIGINT) AS score FROM {PARTS}""")
def score_weighted(spark, sf_dir):
    p = _parts(spark, sf_dir)
    score = ranking.match_score(F.col("price"), F.col("size"), F.lit(None).cast("int"), F.col("layout"), F.col("p_brand") == "Brand#2", {"layout": 25, "size": 35, "place": 10, "price": 30}, {"layouts": ["ECONOMY"], "size": 40, "price": 930})
    return p.select("p_partkey", score.alias("score"))


@registered(f"SELECT p_partkey, size, row_number() OVER (ORDER BY size DESC NULLS LAST, price DESC, p_partkey) AS rank FROM {PARTS} ORDER BY rank LIMIT 50")
def sort_nulls_last_topk(spark, sf_dir):
    return ranking.top_k(_parts(spark, sf_dir), 50, F.desc_nulls_last("size"), F.desc("price"), F.asc("p_partkey")).select("p_partkey", "size", "rank")


@registered("SELECT p_partkey, p_brand, rank FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM part) WHERE rank <= 10")
def budget_topn_per_source(spark, sf_dir):
    return ranking.budget_per_group(table(spark, sf_dir, "part"), "p_brand", 10, F.asc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "p_brand", "rank")


@registered("""WITH k AS (SELECT p_partkey, p_brand, nullif(p_size, 13) AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS i, count(*) OVER (PARTITION BY p_brand) AS n, rank() OVER (PARTITION BY p_brand ORDER BY v) AS k, count(*) OVER (PARTITION BY p_brand, v) AS t, min(v) OVER (PARTITION BY p_brand) AS lo, max(v) OVER (PARTITION BY p_brand) AS hi FROM k WHERE v IS NOT NULL),
  m AS (SELECT *, (SELECT median(b.v) FROM r b WHERE b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey) AS middle FROM r a)
  SELECT k.p_partkey, CAST(coalesce(m.n - 1, 0) AS BIGINT) AS others, CASE WHEN m.n > 1 THEN CAST(floor(100.0 * (m.k - 1) / (m.n - 1) + 0.5) AS BIGINT) END AS below_percent, CASE WHEN m.n > 1 THEN CAST(floor(100.0 * (m.n - m.k - m.t + 1) / (m.n - 1) + 0.5) AS BIGINT) END AS above_percent,
    coalesce(m.n > 1 AND m.k = 1 AND m.t = 1, false) AS is_lowest, coalesce(m.n > 1 AND m.k = m.n AND m.t = 1, false) AS is_highest, CASE WHEN m.n > 1 THEN lo END AS lowest, CASE WHEN m.n > 1 THEN hi END AS highest, middle,
    CASE WHEN middle <> 0 THEN CAST(floor(100.0 * (m.v - middle) / middle + 0.5) AS BIGINT) END AS middle_percent FROM k LEFT JOIN m USING (p_partkey)""")
def standing(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.nullif(F.col("p_size"), F.lit(13)).alias("size"))
    return ranking.standing(rows, "p_brand", "size").drop("p_brand", "size")


@registered("SELECT low, high, stop, CAST(ceil((high - low) / stop) + 1 AS BIGINT) AS stops FROM (SELECT low, high, greatest(1, ceil((high - low) / 500.0 / 20)) * 500.0 AS stop FROM (SELECT floor(min(o_totalprice) / 500.0) * 500.0 AS low, ceil(max(o_totalprice) / 500.0) * 500.0 AS high FROM orders))")
def facet_scale(spark, sf_dir):
    return ranking.facet_scale(table(spark, sf_dir, "orders"), "o_totalprice", 500.0).select(*(F.col(c).cast("double").alias(c) for c in ("low", "high", "stop")), "stops")


@registered("""SELECT l_partkey, arg_min(struct_pack(p := p, o := l_orderkey), (p IS NULL, coalesce(p, 0), l_shipdate, l_orderkey * 10 + l_linenumber)).p AS price, min(l_shipdate) AS first_seen, count(*) AS members
  FROM (SELECT *, nullif(l_extendedprice, 0) AS p FROM lineitem) GROUP BY l_partkey""")
def cheapest_rollup(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.nullif(F.col("l_extendedprice"), F.lit(0.0)).alias("price"), F.col("l_shipdate").alias("seen"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return ranking.cheapest_of_group(items, "l_partkey", "price", "seen", "id").select("l_partkey", "price", "first_seen", "members")


@registered("SELECT o_orderkey, CASE WHEN f IS NOT NULL THEN 'favourite' WHEN u IS NOT NULL THEN 'updated' WHEN v IS NOT NULL THEN 'viewed' ELSE 'new' END AS section, coalesce(f, u, v, o_orderdate) AS placed_at FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS f, CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate END AS u, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS v FROM orders)")
def inbox_sections(spark, sf_dir):
    on = lambda test: F.when(test, F.col("o_orderdate"))
    place = ranking.inbox_place(on(F.col("o_orderpriority") == "1-URGENT"), on(F.col("o_orderpriority") == "2-HIGH"), on(F.col("o_orderstatus") == "F"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", place["section"].alias("section"), place["at"].alias("placed_at"))


# -- linkage ---------------------------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source"), F.col("p_name").alias("name"), F.col("p_type").alias("layout"), (F.col("p_retailprice") * 10).alias("price"), F.col("p_size").alias("size"), F.lit(None).cast("int").alias("land"))


def _scored(spark, sf_dir):
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # the block of shared names, as far as the SQL of the queries goes: layouts are equal, prices may be missing or far apart
    pairs = linkage.candidates(_records(spark, sf_dir), "name", "layout", price=None)
    total = linkage.layout_points(a("layout"), b("layout")) + linkage.price_points(a("price"), b("price")) + linkage.size_points(a("size"), b("size")) + F.lit(float(linkage.NAME_POINTS["street"]))
    agrees = linkage.property_agrees("flat", a("layout"), b("layout"), a("price"), b("price"), a("size"), b("size"), a("land"), b("land"))
    return pairs.select(a("ord").alias("i"), b("ord").alias("j"), a("layout").alias("layout"), total.alias("total"), agrees.alias("agrees"), linkage.price_gap(a("price"), b("price")).alias("gap"), F.lit(False).alias("keep_j"))


PAIRS = """(SELECT a.p_partkey AS i, b.p_partkey AS j, a.p_type AS layout, 45.0 + CASE WHEN g <= 0.10 THEN 15 * (1 - g / 0.10) ELSE -25 * least(1.0, (g - 0.10) / 0.20) END
    + CASE WHEN d <= 2 THEN 10.0 WHEN d <= 6 THEN 10 * (1 - (d - 2) / 4.0) ELSE -15 * least(1.0, (d - 6) / 10.0) END AS total, g <= 0.10 AND d <= 6 AS agrees
  FROM (SELECT a, b, abs(a.p_retailprice * 10 - b.p_retailprice * 10) / greatest(a.p_retailprice * 10, b.p_retailprice * 10) AS g, abs(a.p_size - b.p_size) AS d
    FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand))"""


@registered(f"SELECT i, j, round(total, 6) AS total FROM {PAIRS}")
def pair_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("i", "j", F.round("total", 6).alias("total"))


@registered(f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN total < 30 THEN 'no_match' WHEN total >= 55 AND agrees THEN 'match' ELSE 'uncertain' END AS band FROM {PAIRS}) GROUP BY band")
def pair_bands(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(linkage.band(F.col("total"), F.lit(True), F.col("agrees")).alias("band")).agg(F.count("*").alias("n"))


@registered("SELECT p_partkey, CAST((p_name IS NOT NULL)::INT + (nullif(p_size, 13) IS NOT NULL)::INT + (nullif(p_type, 'PROMO') IS NOT NULL)::INT + (p_retailprice IS NOT NULL)::INT AS INTEGER) AS known FROM part")
def completeness_keeper(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", linkage.completeness(F.col("p_name"), F.nullif(F.col("p_size"), F.lit(13)), F.nullif(F.col("p_type"), F.lit("PROMO")), F.col("p_retailprice")).alias("known"))


# -- texts and pages -------------------------------------------------------------------------------------------------


@registered(f"SELECT doc_id, lower(translate(trim(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g')), '{text.MARKED}', '{text.PLAIN}')) AS name FROM documents")
def normalize_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@registered(f"SELECT doc_id, lower(translate(trim(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g')), '{text.MARKED}', '{text.PLAIN}')) AS name FROM documents")
def normalize_texts(spark, sf_dir):
    """The same as normalize_names, which once read the first 200 characters of a text only."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@registered("SELECT p_partkey, p_size AS size_m2, p_size * 10 + 1000 AS land_m2, CAST(p_size AS VARCHAR) AS number, CAST(p_partkey % 9 AS VARCHAR) || 'b' AS entrance FROM part")
def extract_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ad = F.concat(F.lit("Byt "), F.col("p_size").cast("string"), F.lit(" m², pozemek 1 "), F.lpad((F.col("p_size") * 10).cast("string"), 3, "0"), F.lit(" m2"))
    street = text.house_numbers(F.concat(F.lit("Ulice "), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 9).cast("string"), F.lit("b")))
    return p.select("p_partkey", text.size_m2(ad).alias("size_m2"), text.land_m2(ad).alias("land_m2"), street["number"].alias("number"), street["entrance"].alias("entrance"))


@registered("SELECT c_custkey, c_name || '|' || n_name AS names, r_name AS district FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def address_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = text.split_address(F.concat(F.col("c_name"), F.lit(" - "), F.col("n_name"), F.lit(",  okres "), F.col("r_name")))
    return c.select("c_custkey", F.array_join(parts["names"], "|").alias("names"), parts["district"].alias("district"))


@registered("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1+kk' WHEN 1 THEN 'atypical' WHEN 2 THEN CAST(p_partkey % 9 + 1 AS VARCHAR) || '+kk' WHEN 3 THEN CAST(p_partkey % 9 + 1 AS VARCHAR) || '+1' END AS layout FROM part")
def disposition_parse(spark, sf_dir):
    n = (F.col("p_partkey") % 9 + 1).cast("string")
    ad = F.when(F.col("p_partkey") % 5 == 0, "Garsoniéra").when(F.col("p_partkey") % 5 == 1, " ATYPICKÝ ").when(F.col("p_partkey") % 5 == 2, F.concat(n, F.lit(" + KK"))).when(F.col("p_partkey") % 5 == 3, F.concat(n, F.lit("+1"))).otherwise(F.concat(n, F.lit("+2")))
    return table(spark, sf_dir, "part").select("p_partkey", text.layout_code(ad).alias("layout"))


@registered("""SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(pages.title(F.col("html")), F.lit("")).alias("title"))


@registered("""SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct, coalesce(l[1], '') AS first_link FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def page_links(spark, sf_dir):
    every = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    own = pages.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(every).cast("long").alias("n_links"), F.size(own).cast("long").alias("n_distinct"), F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("")).alias("first_link"))


@registered("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@registered("SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS doc_id, min(n_chars) AS n_chars FROM documents GROUP BY source")
def first_wins(spark, sf_dir):
    return pages.first_of_each(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@registered("""WITH h AS (SELECT o_orderstatus AS source, CAST(o_orderkey % 40 AS BIGINT) AS page, o_custkey AS id FROM orders), f AS (SELECT source, id, min(page) AS page FROM h GROUP BY 1, 2), n AS (SELECT source, page, count(*) AS new_ids FROM f GROUP BY 1, 2),
  p AS (SELECT source, page, coalesce(new_ids, 0) AS new_ids FROM (SELECT DISTINCT source, page FROM h) LEFT JOIN n USING (source, page))
  SELECT source, page, new_ids, new_ids = 0 AND page = min(page) FILTER (new_ids = 0) OVER (PARTITION BY source) AS stops FROM p""")
def paging_stop(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), (F.col("o_orderkey") % 40).alias("page"), F.col("o_custkey").alias("id"))
    return pages.new_per_page(hits, "source", "page", "id")


@registered(f"""SELECT item, price, drop_from, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item, price, previous AS drop_from, CAST(round_even(0.7 * greatest(0.0, least(100.0, (2 - CASE WHEN price <> 0 THEN price END / 2.0) * 100)) + 0.3 * least(100.0, p_size / 30.0 * 100), 0) AS BIGINT) AS score
  FROM {PREVIOUS} JOIN part ON p_partkey = item WHERE previous > price AND price > 0) ORDER BY rank LIMIT 25""")
def best_price_drops(spark, sf_dir):
    """Items whose price dropped, best score first: history, a join to the items' facts, score and order in one plan."""
    drops = history.with_drop(history.previous_different(observations(spark, sf_dir), *KEYS), "price").where("drop_from is not null and price > 0")
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_size")
    scored = drops.join(facts, "item")
    score = ranking.match_score(F.col("price"), F.col("p_size"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(False), {"price": 70, "size": 30}, {"price": 2, "size": 30})
    return ranking.top_k(scored.select("item", "price", "drop_from", score.alias("score")), 25, F.desc("score"), F.asc("item")).select("item", "price", "drop_from", "score", "rank")


SCANS = 6


@registered(f"""WITH s AS (SELECT event_id % {SCANS} AS n, ts, user_id FROM events WHERE (user_id * 3 + event_id % {SCANS}) % 4 > 0), c AS (SELECT n, max(ts) AS at FROM s GROUP BY 1), h AS (SELECT DISTINCT user_id, n FROM s)
  SELECT user_id, min(f.at) AS first_seen, max(l.at) AS last_seen, {SCANS} - 1 - max(last) AS misses FROM (SELECT user_id, min(n) AS first, max(n) AS last FROM h GROUP BY 1) JOIN c f ON f.n = first JOIN c l ON l.n = last GROUP BY user_id""")
def stream_state(spark, sf_dir):
    """Events as a stream of scans, a batch each, that advance a snapshot table; each scan misses some items."""
    folder = f"{scans.shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").where((F.col("user_id") * 3 + F.col("event_id") % SCANS) % 4 > 0)
    kind = events.schema["ts"].dataType.simpleString()
    tracked = scans.SnapshotTable(spark, f"{folder}/state", f"user_id long, first_seen {kind}, last_seen {kind}, misses long")
    for k in range(SCANS):
        events.where(F.col("event_id") % SCANS == k).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/arrived")
        scans.track(stream, tracked, "user_id", "ts", f"{folder}/offsets").awaitTermination()
    return tracked.read()


from larkspur.plans import evidence, fields, geodata, places, scanning, tracking  # noqa: E402, F401  (they register their queries)
