"""Registered queries of paged scans, isolated sources and scan after scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import scan
from larkspur.plans.catalog import registered, table
from larkspur.plans.linking import FOLD, to_link
from larkspur.sources import paged, pages
from larkspur.streaming import commit, scans

C = F.col

# Orders in pages of 20 as the results of portals (a hundred customers each); every fifth portal serves one page again and again, another
# serves an empty page, others stop short of the total or reach it early.
PAGED = """SELECT source, page, place, CASE WHEN source % 5 = 1 AND page >= 4 THEN 'r' || place WHEN key % 50 = 0 THEN NULL ELSE 'a' || key % 400 END AS id, NOT (source % 5 = 2 AND page = 6) AS served, CASE WHEN source % 3 = 0 THEN 150 ELSE total END AS total, key
  FROM (SELECT o_custkey // 100 AS source, o_orderkey AS key, (row_number() OVER w - 1) // 20 + 1 AS page, (row_number() OVER w - 1) % 20 AS place, count(*) OVER (PARTITION BY o_custkey // 100) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey // 100 ORDER BY o_orderkey))"""
STOPS = f"""WITH h AS ({PAGED}), f AS (SELECT source, id, min(page) AS page FROM h WHERE served AND id IS NOT NULL GROUP BY 1, 2), n AS (SELECT source, page, count(*) AS new FROM f GROUP BY 1, 2),
  p AS (SELECT source, page, count(*) FILTER (served) AS results, max(total) AS total, coalesce(max(new), 0) AS new FROM h LEFT JOIN n USING (source, page) GROUP BY 1, 2),
  k AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY page) AS known FROM p),
  s AS (SELECT source, page, CASE WHEN results = 0 THEN 'empty' WHEN known >= total THEN 'total' WHEN new = 0 THEN 'repeated' WHEN page >= 50 THEN 'cap' END AS why FROM k),
  l AS (SELECT source, coalesce(min(page) FILTER (why IS NOT NULL), max(page)) AS last_page, coalesce(arg_min(why, page) FILTER (why IS NOT NULL), 'end') AS why FROM s GROUP BY 1)"""


def _portals(spark, sf_dir) -> str:
    """Pages of the portals, stored in the shared folder."""
    own = Window.partitionBy("source").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(C("o_custkey") / 100).cast("long").alias("source"), "o_orderkey")
    rows = rows.withColumn("i", F.row_number().over(own) - 1).join(rows.groupBy("source").agg(F.count("*").alias("total")), "source")
    rows = rows.select("source", "o_orderkey", (F.floor(C("i") / 20) + 1).cast("int").alias("page"), (C("i") % 20).alias("place"), F.when(C("source") % 3 == 0, 150).otherwise(C("total")).alias("total"))
    key = C("o_orderkey")
    id_ = F.when((C("source") % 5 == 1) & (C("page") >= 4), F.concat(F.lit("r"), C("place"))).when(key % 50 != 0, F.concat(F.lit("a"), key % 400))
    result = F.when(~((C("source") % 5 == 2) & (C("page") == 6)), F.struct(id_.alias("hash_id"), key.alias("key")))
    folder = f"{scans.shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    paged.write_pages(rows.withColumn("result", result), folder, "source", "page", "place", "result", "total")
    return folder


@registered(STOPS + """ SELECT h.source, h.id, h.page, h.place, h.key FROM h JOIN l USING (source) WHERE served AND id IS NOT NULL AND h.page <= last_page QUALIFY row_number() OVER (PARTITION BY h.source, h.id ORDER BY h.page, h.place) = 1""")
def paged_scan(spark, sf_dir):
    """What a scan of all portals gives: each id where it comes first, up to where the scan stops."""
    found = paged.paged_scan(paged.stored_pages(spark, _portals(spark, sf_dir)))
    return found.select(C("source").cast("long").alias("source"), "id", C("page").cast("long").alias("page"), C("place").cast("long").alias("place"), F.get_json_object("result", "$.key").cast("long").alias("key"))


@registered(STOPS + " SELECT source, CAST(last_page AS BIGINT) AS last_page, why FROM l")
def scan_stops(spark, sf_dir):
    """Where each portal's scan stops, and by which rule."""
    return paged.stops(paged.stored_pages(spark, _portals(spark, sf_dir))).select(C("source").cast("long").alias("source"), C("last_page").cast("long").alias("last_page"), "why")


@registered("""SELECT source, CAST(rank AS INTEGER) AS source_rank, CASE WHEN health = 'broken' THEN 0 ELSE found END AS found, health FROM (
  SELECT source, rank, count(o_orderkey) AS found, CASE WHEN source = 'F' THEN 'broken' WHEN count(o_orderkey) = 0 THEN 'zero_results' ELSE 'ok' END AS health FROM (VALUES ('O', 0), ('F', 1), ('none', 2), ('P', 3)) s(source, rank) LEFT JOIN orders ON o_orderstatus = source GROUP BY 1, 2)""")
def isolated_sources(spark, sf_dir):
    """Health of four sources, one of which fails while its rows are read: the others are read all the same."""
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), "o_orderstatus")
    late = F.when(C("id") >= 0, F.raise_error(F.lit("the portal changed its contract"))).otherwise(C("id"))
    own = lambda s: (lambda: orders.where(C("o_orderstatus") == s).select("id"))
    _, health = pages.read_sources(spark, {"O": own("O"), "F": lambda: own("F")().select(late.cast("long").alias("id")), "none": own("none"), "P": own("P"), "off": own("O")}, ["O", "F", "none", "P"], "id")
    return health.drop("error")


@registered("""SELECT source, CAST(rank AS INTEGER) AS source_rank, o_orderkey AS position FROM orders JOIN (VALUES ('P', 0), ('O', 2)) s(source, rank) ON o_orderstatus = source""")
def scan_order(spark, sf_dir):
    """The results of the enabled sources with their place in a whole scan: by the source's rank in the registry, then as they came."""
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), "o_orderstatus")
    own = lambda s: (lambda: orders.where(C("o_orderstatus") == s).select("id"))
    rows, _ = pages.read_sources(spark, {"P": own("P"), "F": own("F"), "O": own("O")}, ["P", "O"], "id")
    return rows.select("source", "ord.source_rank", C("ord.position").alias("position"))


# -- scans from their sources to their commits -----------------------------------------------------------------------

N_SCANS = 5


def _of_scan(s: int) -> str:
    """keeper and id of all postings of a scan, by the linkage's SQL over the parts that it shows at their prices of that day."""
    sql = FOLD.replace("p_partkey AS ord", f"p_partkey % 3 * {scan.PLACES} + p_partkey AS ord").replace("p_brand AS source", "'s' || p_partkey % 3 AS source")
    sql = sql.replace("FROM part", f"FROM (SELECT * FROM part WHERE (p_partkey + {s}) % 7 < 4)").replace("CAST(1000 + p_partkey * 37 % 700 AS BIGINT)", f"CAST(1000 + p_partkey * 37 % 700 - (p_partkey + {s}) % 3 * 10 AS BIGINT)")
    return f"{sql} SELECT {s} AS s, ord % {scan.PLACES} AS keeper, ord % {scan.PLACES} AS id FROM r WHERE ord NOT IN (SELECT removed FROM fold) UNION ALL SELECT {s}, keeper % {scan.PLACES}, removed % {scan.PLACES} FROM final"


@registered(f"""WITH m AS ({' UNION ALL '.join(f'SELECT * FROM ({_of_scan(s)})' for s in range(N_SCANS))}),
  p AS (SELECT s, keeper, id, CASE WHEN id % 13 <> 0 THEN 1000 + id * 37 % 700 - (id + s) % 3 * 10 END AS price, id % 11 = 0 AS viewed, lag(s) OVER (PARTITION BY id ORDER BY s) AS last FROM m),
  q AS (SELECT *, last IS NOT NULL AS seen, CASE WHEN last IS NOT NULL AND id % 13 <> 0 THEN 1000 + id * 37 % 700 - (id + last) % 3 * 10 END AS old FROM p),
  k AS (SELECT s, keeper, bool_or(seen OR viewed) AS known, bool_or(viewed) AND bool_or(NOT seen OR coalesce(old <> price, false)) AS updated, max(CASE WHEN id = keeper AND old > price THEN old END) AS dropped FROM q GROUP BY 1, 2),
  gone AS (SELECT n.s, count(*) AS disappeared FROM (SELECT s, id FROM range({N_SCANS}) t(s), (SELECT DISTINCT id FROM m) i WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.id = i.id AND x.s = t.s)) n
    WHERE (SELECT max(x.s) FROM m x WHERE x.id = n.id AND x.s < n.s) <= n.s - 3 GROUP BY 1)
  SELECT CAST(s AS INTEGER) AS scan, count(*) AS total, count(*) FILTER (NOT known) AS new, count(*) FILTER (updated) AS updated, count(*) FILTER (known AND dropped IS NOT NULL) AS price_drops, coalesce(any_value(disappeared), 0) AS disappeared FROM k LEFT JOIN gone USING (s) GROUP BY s""")
def five_scans(spark, sf_dir):
    """Five scans of three portals one after the other, each from its sources to its commit; parts come, go and change their price."""
    store = commit.Store(spark, f"{scans.shared_dir(spark)}/scans-{uuid.uuid4().hex}")
    parts, out = to_link(spark, sf_dir).withColumnRenamed("ord", "id").drop("source"), None
    for s in range(N_SCANS):
        today = parts.where((C("id") + s) % 7 < 4).withColumn("price", C("price") - (C("id") + s) % 3 * 10)
        own = lambda k: (lambda: today.where(C("id") % 3 == k))  # noqa: B023, E731
        found = scan.run_scan(store, s, {f"s{k}": own(k) for k in range(3)}, ["s0", "s1", "s2"], "flat", F.lit(f"2026-03-0{s + 1} 08:00:00").cast("timestamp"), parts.where("id % 11 = 0").select("id"))
        one = found.counts.select(F.lit(s).alias("scan"), "*")
        out = one if out is None else out.unionByName(one)
    return out
