"""Registered queries of tracking, galleries, profiles and whole linkage.

Orders are postings (of the flat o_custkey, on the portal o_orderstatus), lineitem holds their prices and photos, customers are
profiles or flats, parts are records to link.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import gallery, history, linkage, profiles, ranking, state, tracking
from larkspur.plans.catalog import registered, table
from larkspur.plans.linking import FOLD, SCORED, to_link

C = F.col
L = lambda c: F.col(c).cast("long")


# -- scan diff -------------------------------------------------------------------------------------------------------

MEMBERS = "(SELECT o_custkey AS keeper, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price, o_orderpriority AS pr FROM orders)"
KEYED = f"(SELECT first_value(id) OVER (PARTITION BY keeper ORDER BY seq) AS keeper, id, seq, price, pr FROM {MEMBERS})"


def _members(spark, sf_dir):
    """Postings of a customer as the members of a flat, the first one as its keeper."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("keeper"))
    rows = ranking.running_index(o, "o_custkey", C("o_orderkey"), start=-1).join(first, "o_custkey")
    return rows.select(L("keeper").alias("keeper"), L("o_orderkey").alias("id"), C("index").alias("seq"), F.floor(C("o_totalprice") / 1000).cast("long").alias("price"), C("o_orderpriority").alias("pr"))


@registered(f"""WITH m AS (SELECT *, pr <> '5-LOW' AS seen, pr = '1-URGENT' AS viewed, CASE WHEN id % 3 = 0 THEN price + 5 WHEN id % 3 = 1 THEN price WHEN id % 9 = 2 THEN 0 END AS old FROM {KEYED})
  SELECT keeper, NOT bool_or(seen OR viewed) AS is_new, CASE WHEN bool_or(seen OR viewed) THEN max(CASE WHEN id = keeper AND old > price AND price > 0 THEN old END) END AS drop_from,
    bool_or(viewed) AND bool_or(NOT seen OR coalesce(old <> 0 AND price <> 0 AND old <> price, false)) AS is_updated FROM m GROUP BY keeper""")
def scan_classification(spark, sf_dir):
    m = _members(spark, sf_dir)
    old = m.select("id", F.when(C("id") % 3 == 0, C("price") + 5).when(C("id") % 3 == 1, C("price")).when(C("id") % 9 == 2, 0).cast("long").alias("price"))
    return tracking.classify(m.select("keeper", "id", "seq", "price"), m.where("pr <> '5-LOW'").select("id"), m.where("pr = '1-URGENT'").select("id"), old)


@registered(f"SELECT keeper, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq) AS members FROM {KEYED} GROUP BY keeper")
def grouped_members(spark, sf_dir):
    m = _members(spark, sf_dir)
    merges = m.where("seq > 0").select(C("id").alias("absorbed"), "keeper", "seq")
    rows = tracking.grouped_members(tracking.members_of(m.where("seq = 0").select("id"), merges))
    return rows.select("keeper", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@registered("SELECT DISTINCT o_orderkey AS id FROM orders")
def current_ids(spark, sf_dir):
    m = _members(spark, sf_dir)
    return tracking.current_ids(m.where("seq = 0"), m.where("seq > 0").select(C("id").alias("absorbed")))


OWNED = "CASE WHEN id % 4 = 1 THEN 'p' || id % 50 END"


@registered(f"""SELECT keeper, coalesce(arg_min(p, (seq, id)) FILTER (p IS NOT NULL), sha256('scan 1|' || keeper)) AS property, count(p) = 0 AS created FROM (SELECT *, {OWNED} AS p FROM {KEYED}) GROUP BY keeper""")
def property_identity(spark, sf_dir):
    m = _members(spark, sf_dir)
    owned = m.where("id % 4 = 1").select("id", F.concat(F.lit("p"), (C("id") % 50).cast("string")).alias("property"))
    return tracking.identities(m, owned, "scan 1")[0]


@registered(f"""WITH r AS (SELECT *, {OWNED} AS p FROM {KEYED}), w AS (SELECT keeper, arg_min(p, (seq, id)) FILTER (p IS NOT NULL) AS winner FROM r GROUP BY keeper)
  SELECT DISTINCT p AS loser, winner FROM r JOIN w USING (keeper) WHERE p IS NOT NULL AND p <> winner""")
def property_folds(spark, sf_dir):
    m = _members(spark, sf_dir)
    owned = m.where("id % 4 = 1").select("id", F.concat(F.lit("p"), (C("id") % 50).cast("string")).alias("property"))
    return tracking.identities(m, owned, "scan 1")[1]


ACTION = "CASE event_type WHEN 'view' THEN 'view' WHEN 'error' THEN 'clear' WHEN 'click' THEN 'favourite' ELSE 'update' END"


@registered(f"""WITH a AS (SELECT user_id, ts, event_id, {ACTION} AS action FROM events), c AS (SELECT user_id, max((ts, event_id)) AS cleared FROM a WHERE action = 'clear' GROUP BY 1),
  g AS (SELECT a.user_id, min(ts) FILTER (action IN ('view', 'favourite')) AS viewed_at, min(ts) FILTER (action = 'favourite' AND (cleared IS NULL OR (ts, event_id) > cleared)) AS favourited_at,
    max((ts, event_id)) FILTER (action = 'update') AS u, max((ts, event_id)) FILTER (action = 'view') AS v FROM a LEFT JOIN c USING (user_id) GROUP BY 1)
  SELECT user_id, viewed_at, favourited_at, CASE WHEN v IS NULL OR u > v THEN u[1] END AS updated_at FROM g""")
def action_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(C("event_type") == "view", "view").when(C("event_type") == "error", "clear").when(C("event_type") == "click", "favourite").otherwise("update")
    return tracking.reduce_actions(e.select("user_id", C("ts").alias("at"), C("event_id").alias("seq"), action.alias("action")), "user_id")


@registered("SELECT event_type AS source, max(ts) AS seen_at, arg_max(CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE 'ok' END, (ts, event_id)) AS health FROM events GROUP BY 1")
def latest_source_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C("event_type").alias("source"), C("ts").alias("at"), "event_id", F.when(C("event_id") % 3 == 0, "broken").otherwise("ok").alias("health"))
    return tracking.latest_health(e, "source", "at", "event_id", "health").drop("event_id").withColumnRenamed("at", "seen_at")


@registered("""SELECT c_custkey, viewed IS NULL OR updated IS NOT NULL AS open, viewed IS NULL AS only_new FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 1 END AS viewed, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS updated FROM customer)""")
def new_or_updated(spark, sf_dir):
    viewed, updated = F.when(C("c_custkey") % 3 > 0, 1), F.when(C("c_custkey") % 4 == 0, 1)
    return table(spark, sf_dir, "customer").select("c_custkey", tracking.new_or_updated(viewed, updated).alias("open"), viewed.isNull().alias("only_new"))


@registered("""SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS DISTINCT FROM event_type""")
def last_of_run(spark, sf_dir):
    return tracking.last_of_runs(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", by=("user_id",)).select("event_id", "user_id", "event_type")


# -- the tracked read model ------------------------------------------------------------------------------------------

TRACKING = """(SELECT p.profile, c_custkey AS property, CAST(c_custkey * 2 AS BIGINT) AS index, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 HOUR END AS viewed_at, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-02-01' + c_custkey * INTERVAL 1 HOUR END AS favourited_at,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-03-01' + c_custkey * INTERVAL 1 HOUR END AS updated_at FROM customer, (VALUES ('a'), ('b')) p(profile) WHERE p.profile = 'a' OR c_custkey % 2 = 0)"""
LISTED = "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS profile, o_orderkey AS id, o_orderdate AS first_seen FROM orders)"
PRICED = "(SELECT l_orderkey AS id, l_shipdate AS seen_at, l_orderkey * 10 + l_linenumber AS n, max(CAST(floor(l_extendedprice / 10000) AS BIGINT)) AS price FROM lineitem GROUP BY 1, 2, 3)"


def _tracking(spark, sf_dir):
    hours = lambda day: F.lit(day).cast("timestamp_ntz") + F.make_interval(hours=C("c_custkey").cast("int"))
    when = lambda test, day: F.when(test, hours(day))
    c = C("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("profile", F.explode(F.when(c % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    return rows.select("profile", L("c_custkey").alias("property"), (L("c_custkey") * 2).alias("index"), when(c % 3 > 0, "2024-01-01").alias("viewed_at"), when(c % 5 == 0, "2024-02-01").alias("favourited_at"), when(c % 4 == 0, "2024-03-01").alias("updated_at"))


def _postings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(L("o_orderkey").alias("id"), L("o_custkey").alias("property"), C("o_orderstatus").alias("source"), F.concat(F.lit("u"), C("o_orderkey").cast("string")).alias("url"), C("o_orderdate").alias("first_seen"), F.when(C("o_orderkey") % 3 == 0, "b").otherwise("a").alias("profile"))


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(L("l_orderkey").alias("id"), C("l_shipdate").alias("at"), (L("l_orderkey") * 10 + C("l_linenumber")).alias("n"), F.floor(C("l_extendedprice") / 10000).cast("long").alias("price")).groupBy("id", "at", "n").agg(F.max("price").alias("price"))


READ = f"""WITH latest AS (SELECT id, arg_max(price, (seen_at, n, price)) AS price FROM {PRICED} GROUP BY id), prev AS (SELECT l.id, l.price, arg_max(o.price, (o.seen_at, o.n, o.price)) AS previous FROM latest l LEFT JOIN {PRICED} o ON o.id = l.id AND o.price <> l.price GROUP BY 1, 2),
  r AS (SELECT t.*, o.o_orderkey AS id, o_orderstatus AS source, first_seen, price, CASE WHEN previous > price THEN previous END AS drop_from FROM {TRACKING} t JOIN orders o ON o.o_custkey = t.property JOIN {LISTED} k ON k.profile = t.profile AND k.id = o.o_orderkey LEFT JOIN prev p ON p.id = o.o_orderkey),
  s AS (SELECT *, row_number() OVER (PARTITION BY profile, property ORDER BY price IS NULL, coalesce(price, 0), first_seen, id) AS k FROM r),
  model AS (SELECT profile, property, index, viewed_at, favourited_at, updated_at, id AS listing, source, price, drop_from, (SELECT min(first_seen) FROM s x WHERE x.profile = s.profile AND x.property = s.property) AS first_seen,
    coalesce((SELECT string_agg(source || ':u' || id, ',' ORDER BY source, id) FROM s x WHERE x.profile = s.profile AND x.property = s.property AND x.k > 1), '') AS siblings FROM s WHERE k = 1)"""


def _model(spark, sf_dir):
    p = _postings(spark, sf_dir)
    return tracking.tracked_properties(_tracking(spark, sf_dir), p.select("id", "property", "source", "url"), p.select("profile", "id", "first_seen"), _prices(spark, sf_dir))


@registered(READ + " SELECT profile, property, index, listing, source, price, drop_from, first_seen, siblings FROM model")
def tracked_properties(spark, sf_dir):
    joined = F.array_join(F.transform("siblings", lambda s: F.concat(s["source"], F.lit(":"), s["url"])), ",")
    return _model(spark, sf_dir).select("profile", "property", "index", "listing", "source", "price", "drop_from", "first_seen", joined.alias("siblings"))


@registered(READ + """, p AS (SELECT profile, property, CASE WHEN favourited_at IS NOT NULL THEN 'favourite' WHEN updated_at IS NOT NULL THEN 'updated' WHEN viewed_at IS NOT NULL THEN 'viewed' ELSE 'new' END AS section, coalesce(favourited_at, updated_at, viewed_at, first_seen) AS placed_at FROM model)
  SELECT profile, property, section, CASE section WHEN 'new' THEN 1 WHEN 'updated' THEN 2 WHEN 'favourite' THEN 3 ELSE 4 END AS section_place, row_number() OVER (PARTITION BY profile, section ORDER BY placed_at DESC, property) AS rank FROM p""")
def inbox_order(spark, sf_dir):
    return tracking.inbox(_model(spark, sf_dir), "property").select("profile", "property", "section", "section_place", "rank")


@registered(READ + f""", o AS (SELECT *, CASE WHEN lag(price) OVER w = price THEN 0 ELSE 1 END AS c FROM (SELECT p.*, o_custkey AS property, o_orderstatus AS source FROM {PRICED} p JOIN orders ON o_orderkey = id) WINDOW w AS (PARTITION BY id ORDER BY seen_at, n)),
  runs AS (SELECT property, id, source, run, any_value(price) AS price, min(seen_at) AS seen_at FROM (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY seen_at, n) AS run FROM o) GROUP BY 1, 2, 3, 4),
  m AS (SELECT * FROM model WHERE profile = 'a'), f AS (SELECT r.*, m.listing, m.first_seen, lag(r.price) OVER (PARTITION BY r.id ORDER BY run) AS p FROM runs r JOIN m USING (property)),
  e AS (SELECT property, 0 AS o, 'found' AS kind, first_seen AS seen_at, NULL AS source, NULL AS price_from, NULL AS price_to FROM m UNION ALL SELECT property, 1, 'posted', seen_at, source, NULL, NULL FROM f WHERE run = 1 AND seen_at > first_seen
    UNION ALL SELECT property, 2, 'price_change', seen_at, CASE WHEN id <> listing THEN source END, p, price FROM f WHERE run > 1 UNION ALL SELECT property, 3, 'viewed', viewed_at, NULL, NULL, NULL FROM m WHERE viewed_at IS NOT NULL UNION ALL SELECT property, 4, 'favourite', favourited_at, NULL, NULL, NULL FROM m WHERE favourited_at IS NOT NULL)
  SELECT property, kind, seen_at, source, CAST(price_from AS BIGINT) AS price_from, CAST(price_to AS BIGINT) AS price_to, row_number() OVER (PARTITION BY property ORDER BY seen_at DESC, o, source NULLS FIRST, price_from NULLS FIRST, price_to NULLS FIRST) AS place FROM e""")
def full_event_history(spark, sf_dir):
    model = _model(spark, sf_dir).where("profile = 'a'")
    runs = history.price_runs(_prices(spark, sf_dir), "id", "at", "n", "price")
    postings = runs.join(_postings(spark, sf_dir).select("id", "property", "source"), "id").select("property", C("id").alias("listing"), "source", "run", "price", "first_seen_at")
    return tracking.full_history(model.select("property", "listing", "first_seen"), postings, model.select("property", "viewed_at", "favourited_at")).withColumnRenamed("at", "seen_at")


@registered("""WITH t AS (SELECT *, property % 7 = 0 AS fav FROM (SELECT DISTINCT o_custkey AS property FROM orders UNION SELECT c_custkey FROM customer)) SELECT 'a' AS profile, property FROM t
  WHERE fav OR property IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def tracking_without_listings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(L("o_orderkey").alias("id"), L("o_custkey").alias("property"), "o_orderstatus")
    every = o.select("property").union(table(spark, sf_dir, "customer").select(L("c_custkey"))).distinct().select(F.lit("a").alias("profile"), "property", F.when(C("property") % 7 == 0, 1).alias("favourited_at"))
    return tracking.without_listings(every, o, o.where("o_orderstatus = 'O'").select(F.lit("a").alias("profile"), "id")).select("profile", "property")


@registered("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - 1 END AS merged_into FROM customer), k AS (SELECT id FROM p WHERE id % 9 = 2 UNION SELECT p.merged_into FROM k JOIN p USING (id) WHERE p.merged_into IS NOT NULL)
  SELECT id, merged_into FROM p WHERE id IN (SELECT id FROM k)""")
def remembered_properties(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(L("c_custkey").alias("id"), F.when(C("c_custkey") % 4 != 0, L("c_custkey") - 1).alias("merged_into"))
    return tracking.remembered(p, p.where("id % 9 = 2").select("id"))


@registered("""SELECT item FROM (SELECT o_custkey AS item, min(o_orderdate) AS first_seen, count(*) % 4 AS misses FROM orders GROUP BY 1) WHERE item NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND misses + 1 >= 3 AND first_seen >= TIMESTAMP '1996-03-01' - INTERVAL 700 DAY""")
def disappeared_items(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(L("o_custkey").alias("item")).agg(F.min("o_orderdate").alias("first_seen"), (F.count("*") % 4).alias("misses"))
    scanned = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(L("c_custkey").alias("item"))
    return state.disappeared(t, scanned, "item", F.lit("1996-03-01").cast("timestamp_ntz"), days=700).select("item")


@registered("""SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.first ELSE o.first END AS first, CASE WHEN n.k IS NULL THEN o.last ELSE n.last END AS last FROM (SELECT o_custkey AS k, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1) o
  FULL JOIN (SELECT o_custkey AS k, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1) n ON o.k = n.k""")
def snapshot_upsert(spark, sf_dir):
    part = lambda test: table(spark, sf_dir, "orders").where(test).groupBy(L("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return state.upsert(part(F.year("o_orderdate") < 1996), part(F.year("o_orderdate") >= 1996), "k", ("first",))


# -- galleries -------------------------------------------------------------------------------------------------------

PHOTOS = "(SELECT l_orderkey AS listing, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS position, 'p' || l_partkey % 11 AS url, CASE WHEN l_returnflag <> 'N' THEN 'f' || l_partkey END AS file, CAST(l_quantity AS INTEGER) % 5 AS attempts FROM lineitem)"
POSTED = "(SELECT o_orderkey AS listing, o_custkey AS property FROM orders)"
ASKED = "(SELECT c_custkey AS property, CAST(c_custkey % 17 AS BIGINT) AS requested_at FROM customer WHERE c_custkey % 3 = 0)"
READS = "(SELECT o_orderkey AS listing, CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS read_at, CAST(o_orderkey % 5 AS INTEGER) AS attempts FROM orders WHERE o_orderkey % 2 = 0)"
SHOWN = f"(SELECT property, listing FROM (SELECT l.*, row_number() OVER (PARTITION BY property ORDER BY n DESC, listing) AS k FROM (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.listing) AS n FROM {POSTED} o) l) WHERE k = 1)"


def _gallery(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    photos = ranking.running_index(i, "l_orderkey", *(C(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), start=-1)
    photos = photos.select(L("l_orderkey").alias("listing"), C("index").cast("int").alias("position"), F.concat(F.lit("p"), (C("l_partkey") % 11).cast("string")).alias("url"), F.when(C("l_returnflag") != "N", F.concat(F.lit("f"), C("l_partkey").cast("string"))).alias("file"), (C("l_quantity").cast("int") % 5).alias("attempts"))
    o = table(spark, sf_dir, "orders")
    asked = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(L("c_custkey").alias("property"), (L("c_custkey") % 17).alias("requested_at"))
    reads = o.where("o_orderkey % 2 = 0").select(L("o_orderkey").alias("listing"), F.when(C("o_orderkey") % 4 == 0, 1).alias("read_at"), (C("o_orderkey") % 5).cast("int").alias("attempts"))
    return o.select(L("o_orderkey").alias("listing"), L("o_custkey").alias("property")), photos, asked, reads


@registered(f"SELECT property, listing, position, url FROM {SHOWN} JOIN {PHOTOS} USING (listing) WHERE position = 0 AND file IS NULL AND attempts < 3 AND property NOT IN (SELECT property FROM {ASKED})")
def main_photos(spark, sf_dir):
    listings, photos, asked, _ = _gallery(spark, sf_dir)
    return gallery.main_photos(listings, photos, asked)


@registered(f"SELECT property, listing, position, url, requested_at, row_number() OVER (PARTITION BY property, requested_at ORDER BY listing, position) AS rank FROM {SHOWN} JOIN {PHOTOS} USING (listing) JOIN {ASKED} USING (property) WHERE file IS NULL AND attempts < 3")
def requested_photos(spark, sf_dir):
    listings, photos, asked, _ = _gallery(spark, sf_dir)
    return gallery.requested_photos(listings, photos, asked)


@registered(f"SELECT property, listing, requested_at, row_number() OVER (ORDER BY requested_at DESC, listing) AS rank FROM {SHOWN} JOIN {ASKED} USING (property) JOIN {READS} USING (listing) WHERE read_at IS NULL AND attempts < 3")
def requested_pages(spark, sf_dir):
    listings, photos, asked, reads = _gallery(spark, sf_dir)
    return gallery.requested_pages(listings, photos, asked, reads)


@registered(f"""WITH g AS (SELECT property, listing, property IN (SELECT property FROM {ASKED}) AS requested, listing IN (SELECT listing FROM {READS} WHERE read_at IS NULL AND attempts < 3) AS page FROM {SHOWN}),
  c AS (SELECT property, listing, requested, page, count(position) AS n_photos, count(file) AS stored, count(*) FILTER (position IS NOT NULL AND file IS NULL AND attempts < 3 AND (requested OR position = 0)) AS waiting FROM g LEFT JOIN {PHOTOS} USING (listing) GROUP BY ALL)
  SELECT property, listing, requested, n_photos, stored, waiting, CASE WHEN page THEN 'downloading' WHEN n_photos = 0 THEN 'none' WHEN waiting > 0 THEN 'downloading' WHEN stored > 0 THEN 'stored' ELSE 'failed' END AS status FROM c""")
def gallery_states(spark, sf_dir):
    return gallery.galleries(*_gallery(spark, sf_dir))


@registered(f"""WITH pages AS (SELECT listing, position, 'p' || (position * 3 + listing) % 11 AS url FROM {PHOTOS} WHERE listing % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY listing, url ORDER BY position) AS k FROM pages),
  old AS (SELECT listing, url, arg_max(file, position) AS file, arg_max(attempts, position) AS attempts, arg_max(struct_pack(f := file), position).f AS f FROM {PHOTOS} GROUP BY 1, 2)
  SELECT listing, position, url, file, attempts FROM {PHOTOS} WHERE listing % 3 <> 0 UNION ALL SELECT n.listing, n.position, n.url, o.f, coalesce(o.attempts, 0) FROM n LEFT JOIN old o ON o.listing = n.listing AND o.url = n.url AND n.k = 1""")
def gallery_replaced(spark, sf_dir):
    _, photos, _, _ = _gallery(spark, sf_dir)
    pages = photos.where("listing % 3 = 0").select("listing", "position", F.concat(F.lit("p"), ((C("position") * 3 + C("listing")) % 11).cast("string")).alias("url"))
    return gallery.replaced(photos, pages)


@registered(f"SELECT listing, position, url, file, CASE WHEN listing % 4 = 1 THEN 0 ELSE attempts END AS attempts FROM (SELECT listing, position, url, CASE WHEN listing % 4 = 1 THEN NULL ELSE file END AS file, attempts FROM {PHOTOS})")
def gallery_recorded_once(spark, sf_dir):
    _, photos, _, _ = _gallery(spark, sf_dir)
    return gallery.recorded_once(photos.where("listing % 4 <> 1"), photos.select("listing", "position", "url"))


@registered(f"SELECT listing, position, url, file, CASE WHEN position % 3 = 2 THEN greatest(3, attempts) WHEN position % 3 = 1 THEN attempts + 1 ELSE attempts END AS attempts FROM {PHOTOS}")
def photo_failures(spark, sf_dir):
    _, photos, _, _ = _gallery(spark, sf_dir)
    return gallery.after_failures(photos, photos.where("position % 3 > 0").select("listing", "position", (C("position") % 3 == 2).alias("give_up")))


@registered("SELECT 'old' || p_partkey AS file FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT 'f' || p_partkey FROM part WHERE p_partkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'N')")
def orphan_files(spark, sf_dir):
    _, photos, _, _ = _gallery(spark, sf_dir)
    stored = F.concat(F.when(C("p_partkey") % 3 == 0, "old").otherwise("f"), C("p_partkey").cast("string"))
    return gallery.orphan_files(table(spark, sf_dir, "part").select(stored.alias("file")), photos)


@registered("SELECT user_id AS listing, CAST(k AS INTEGER) AS position, event_id AS url FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k < 20")
def gallery_truncated(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(C("user_id").alias("listing")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("urls"))
    return gallery.truncated(e)


# -- profiles and forms ----------------------------------------------------------------------------------------------


def _profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    head = c.select(L("c_custkey").alias("profile_id"), C("c_name").alias("name"), (L("c_custkey") * 7 % 50).alias("created_at"), F.when(C("c_custkey") % 6 == 0, 1).alias("paused_at"))
    facts = c.select(L("c_custkey").alias("profile_id"), F.floor("c_acctbal").cast("long").alias("max_price"))
    o = table(spark, sf_dir, "orders")
    layouts = o.select(L("o_custkey").alias("profile_id"), L("o_orderkey").alias("rank"), C("o_orderpriority").alias("layout"))
    portals = o.where("o_orderstatus <> 'P'").select(L("o_custkey").alias("profile_id"), C("o_orderstatus").alias("portal")).distinct()
    return head, facts, layouts, portals


@registered("""SELECT c_custkey AS profile_id, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS max_price, coalesce((SELECT string_agg(o_orderpriority, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS layouts,
  coalesce((SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P'), '') AS portals FROM customer""")
def profiles_read(spark, sf_dir):
    head, facts, layouts, portals = _profiles(spark, sf_dir)
    return profiles.read_profiles(head, {"criteria": facts}, {"layouts": layouts, "portals": portals}).select("profile_id", "name", "max_price", F.array_join("layouts", ",").alias("layouts"), F.array_join("portals", ",").alias("portals"))


@registered("SELECT c_custkey AS profile_id, row_number() OVER (ORDER BY c_custkey * 7 % 50, c_custkey) AS place FROM customer WHERE c_custkey % 6 <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') ORDER BY place LIMIT 30")
def profiles_to_run(spark, sf_dir):
    """The first thirty profiles to run, oldest first (the limit is the query's feature)."""
    head, _, _, portals = _profiles(spark, sf_dir)
    first = profiles.oldest_first(profiles.runnable(head, portals)).limit(30)
    return ranking.top_k(first, 30, C("created_at"), C("profile_id")).select("profile_id", C("rank").alias("place"))


@registered("SELECT c_custkey AS profile_id, c_name AS name, CAST(c_custkey * 7 % 50 AS BIGINT) AS created_at FROM customer WHERE c_custkey % 10 NOT IN (3, 4)")
def profiles_round_trip(spark, sf_dir):
    head = _profiles(spark, sf_dir)[0]
    texts = profiles.exported(head.withColumn("name", F.when(C("profile_id") % 10 != 3, C("name"))))
    broken = F.when(F.get_json_object("profile", "$.profile_id").cast("long") % 10 == 4, F.lit("{not json")).otherwise(C("profile"))
    return profiles.imported(texts.select(broken.alias("profile")), "profile_id long, name string, created_at long, paused_at int", ("profile_id", "name")).select("profile_id", "name", "created_at")


@registered("SELECT value, rank FROM (VALUES ('ECONOMY', 1), ('MARBLE', 2), ('PROMO', 3), ('SMALL', 4)) v(value, rank) WHERE value IN (SELECT p_type FROM part)")
def facet_values(spark, sf_dir):
    return profiles.facet_values(table(spark, sf_dir, "part"), "p_type", spark.createDataFrame([("ECONOMY", 1), ("MARBLE", 2), ("PROMO", 3), ("SMALL", 4)], "value string, rank int"))


@registered("SELECT p_partkey, CAST(arg_min(i, (abs(p_size - s), i)) AS INTEGER) AS stop FROM part, (SELECT unnest([0, 15, 20, 25, 30, 35, 40, 45, 50]) AS s, unnest(range(9)) AS i) GROUP BY 1")
def nearest_stop(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", profiles.nearest_stop(C("p_size"), [0, 15, 20, 25, 30, 35, 40, 45, 50]).alias("stop"))


@registered("""WITH w AS (SELECT p_partkey, [p_size, p_partkey % 5, p_partkey % 3] AS w FROM part), e AS (SELECT p_partkey, i, CASE WHEN list_sum(w) = 0 THEN 100.0 / 3 ELSE w[i] * 100.0 / list_sum(w) END AS x FROM w, range(1, 4) r(i)),
  f AS (SELECT *, floor(x) AS v, row_number() OVER (PARTITION BY p_partkey ORDER BY floor(x) - x, i) AS k, 100 - sum(floor(x)) OVER (PARTITION BY p_partkey) AS left_ FROM e), s AS (SELECT p_partkey, list(CAST(v + CASE WHEN k <= left_ THEN 1 ELSE 0 END AS INTEGER) ORDER BY i) AS a FROM f GROUP BY 1),
  b AS (SELECT p_partkey, CASE WHEN a[1] < 5 THEN list_transform(a, lambda v, i: CASE WHEN i = 1 THEN 5 WHEN i = list_position(a, list_max(a)) THEN v - (5 - a[1]) ELSE v END) ELSE a END AS a FROM s),
  c AS (SELECT p_partkey, CASE WHEN a[2] < 5 THEN list_transform(a, lambda v, i: CASE WHEN i = 2 THEN 5 WHEN i = list_position(a, list_max(a)) THEN v - (5 - a[2]) ELSE v END) ELSE a END AS a FROM b),
  d AS (SELECT p_partkey, CASE WHEN a[3] < 5 THEN list_transform(a, lambda v, i: CASE WHEN i = 3 THEN 5 WHEN i = list_position(a, list_max(a)) THEN v - (5 - a[3]) ELSE v END) ELSE a END AS a FROM c)
  SELECT p_partkey, a[1] || ',' || a[2] || ',' || a[3] AS parts FROM d""")
def weights_split(spark, sf_dir):
    w = F.array(C("p_size").cast("double"), (C("p_partkey") % 5).cast("double"), (C("p_partkey") % 3).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(profiles.split_total(w), lambda x: x.cast("string")), ",").alias("parts"))


@registered("""WITH s AS (SELECT p_partkey AS k, CAST(round_even(100 - abs(p_size - 30) * 2.3, 0) AS BIGINT) AS score FROM part), t AS (SELECT unnest([100, 50, 10]) AS target, unnest([0, 1, 2]) AS n),
  p AS (SELECT target, n, arg_min(k, (abs(score - target), k)) AS k FROM s, t GROUP BY 1, 2), q AS (SELECT target, n, p.k, score FROM p JOIN s USING (k)) SELECT target, k, score FROM q WHERE n = (SELECT max(n) FROM q x WHERE x.score = q.score)""")
def nearest_examples(spark, sf_dir):
    samples = table(spark, sf_dir, "part").select(C("p_partkey").alias("k"), F.rint(100 - F.abs(C("p_size") - 30) * 2.3).cast("long").alias("score"))
    return profiles.nearest_examples(samples, "score", (100, 50, 10), "k").select("target", "k", "score")


# -- linkage of whole records ----------------------------------------------------------------------------------------

def _linked(spark, sf_dir):
    return linkage.score(linkage.useful(to_link(spark, sf_dir)), "flat")


@registered(SCORED + " SELECT i, j, total, CASE WHEN total >= 55 AND agrees THEN 'match' ELSE 'uncertain' END AS band FROM scored WHERE evidence AND total >= 30")
def linkage_scores(spark, sf_dir):
    """All pairs of a total of 30 or more with their band, from the three blocks; the SQL looks at all pairs."""
    return _linked(spark, sf_dir).where((C("gps_evidence") | C("name_evidence")) & (F.round("total", 4) >= 30)).select("i", "j", F.round("total", 4).alias("total"), F.when((F.round("total", 4) >= 55) & C("agrees"), "match").otherwise("uncertain").alias("band"))


@registered(FOLD + " SELECT ord, coalesce(sources, '') AS sources FROM r LEFT JOIN (SELECT keeper AS ord, string_agg(source, ',' ORDER BY src.at) AS sources FROM src GROUP BY 1) USING (ord) WHERE ord NOT IN (SELECT removed FROM fold)")
def linkage_survivors(spark, sf_dir):
    """Linkage as a whole: the records that stay, in input order, and the sources that each took in."""
    stay, _, _ = linkage.link(to_link(spark, sf_dir), "flat")
    return stay.select("ord", F.array_join("sources", ",").alias("sources"))


@registered(FOLD + " SELECT removed, keeper, turn, other FROM fold")
def linkage_merges(spark, sf_dir):
    """Each merged record, what it was merged into at last, and the pair by which it went first."""
    _, merged, _ = linkage.link(to_link(spark, sf_dir), "flat")
    return merged.select("removed", "keeper", C("seq.turn").alias("turn"), C("seq.other").alias("other"))


@registered("""WITH RECURSIVE m AS (SELECT c_custkey AS removed, c_custkey - 1 AS keeper, c_nationkey AS seq FROM customer WHERE c_custkey % 4 > 0), c AS (SELECT removed, keeper, seq FROM m UNION ALL SELECT c.removed, m.keeper, c.seq FROM c JOIN m ON m.removed = c.keeper),
  f AS (SELECT removed, min(keeper) AS keeper, any_value(seq) AS seq FROM c GROUP BY 1), s AS (SELECT f.keeper, r.c_mktsegment AS s, min((f.seq, r.c_mktsegment)) AS o FROM f JOIN customer r ON r.c_custkey = removed JOIN customer k ON k.c_custkey = keeper WHERE r.c_mktsegment <> k.c_mktsegment GROUP BY 1, 2)
  SELECT keeper, string_agg(s, ',' ORDER BY o) AS sources FROM s GROUP BY 1""")
def absorbed_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    merged = c.where("c_custkey % 4 > 0").select(F.lit("g").alias("group"), L("c_custkey").alias("removed"), (L("c_custkey") - 1).alias("keeper"))
    final = linkage.final_keepers(merged, "group").join(c.select(L("c_custkey").alias("removed"), L("c_nationkey").alias("seq")), "removed")
    return linkage.absorbed_sources(final, c, "c_custkey", "c_mktsegment").select("keeper", F.array_join("sources", ",").alias("sources"))


@registered("""SELECT a.p_partkey AS id, coalesce(nullif(a.p_size, 13), b.p_size) AS size, coalesce(CASE WHEN a.p_type <> 'PROMO' THEN a.p_type END, b.p_type) AS layout, CASE WHEN b.p_size <> coalesce(nullif(a.p_size, 13), b.p_size) THEN CAST(b.p_size AS VARCHAR) END AS size_differs,
  CASE WHEN b.p_type <> coalesce(CASE WHEN a.p_type <> 'PROMO' THEN a.p_type END, b.p_type) THEN b.p_type END AS layout_differs FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def promoted_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.select((C("p_partkey") - 1).alias("p_partkey"), C("p_size").alias("size_b"), C("p_type").alias("type_b"))
    facts, differs = linkage.promoted({"size": F.nullif(C("p_size"), F.lit(13)), "layout": F.when(C("p_type") != "PROMO", C("p_type"))}, {"size": C("size_b"), "layout": C("type_b")})
    return p.join(b, "p_partkey").select(C("p_partkey").alias("id"), *(v.alias(k) for k, v in facts.items()), differs["size"].alias("size_differs"), differs["layout"].alias("layout_differs"))
