"""Parts as records to link, and linkage in SQL: all pairs scored, and the fold by recursion over the records in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import linkage

C = F.col
L = lambda c: F.col(c).cast("long")

RECORDS = """(SELECT p_partkey AS ord, p_brand AS source, CASE WHEN p_partkey % 7 <> 0 THEN 50.0 + (p_partkey % 61) * 0.002 END AS lat, 14.0 + (p_partkey % 53) * 0.003 AS lon, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE ['gps', 'street', 'part', 'quarter', 'town', 'district'][1 + p_partkey % 6] END AS tier,
  CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 5 = 1 THEN [p_partkey % 40, 100 + p_partkey % 9] ELSE [p_partkey % 40, 200 + p_partkey % 4] END AS names, p_type AS layout,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST(1000 + p_partkey * 37 % 700 AS BIGINT) END AS price, nullif(p_size, 13) AS size FROM part)"""
# names under 40 are streets (every third a part), from 100 on quarters, from 200 on towns
TIER = "CASE WHEN n >= 200 THEN 5 WHEN n >= 100 THEN 4 WHEN n % 3 = 0 THEN 3 ELSE 2 END"
SCORED = f"""WITH r AS (SELECT *, CASE tier WHEN 'gps' THEN 1 WHEN 'street' THEN 2 WHEN 'part' THEN 3 WHEN 'quarter' THEN 4 WHEN 'town' THEN 5 END AS t FROM {RECORDS}),
  p AS (SELECT a, b, greatest(a.t, b.t) AS t0, a.t IS NOT NULL AND b.t IS NOT NULL AS placed, len(a.names) > 0 AND len(b.names) > 0 AS named FROM r a JOIN r b ON a.ord < b.ord AND a.source <> b.source),
  q AS (SELECT *, CASE WHEN placed THEN t0 END AS t, CAST(round_even(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0) AS BIGINT) AS m FROM (SELECT *, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM p)),
  x AS (SELECT *, [35, 35, 20, 10, 6][t] AS c, [100, 400, 1200, 3000, 5000][t] AS near, [1500, 2500, 5000, 12000, 25000][t] AS far, list_min(list_transform(list_intersect(a.names, b.names), lambda n: {TIER})) AS shared,
    list_filter(a.names, lambda n: {TIER} = 2) AS sa, list_filter(b.names, lambda n: {TIER} = 2) AS sb, CASE WHEN a.price <> 0 AND b.price <> 0 THEN abs(a.price - b.price) / greatest(a.price, b.price) END AS g, CASE WHEN a.size <> 0 AND b.size <> 0 THEN abs(a.size - b.size) END AS d FROM q),
  f AS (SELECT a.ord AS i, b.ord AS j, CASE WHEN t IS NULL THEN 0 WHEN m <= near THEN c WHEN m >= far THEN -c ELSE c - 2.0 * c * (m - near) / (far - near) END AS gps,
    CASE WHEN NOT named THEN 0 WHEN len(sa) > 0 AND len(sb) > 0 AND len(list_intersect(sa, sb)) = 0 THEN -35 WHEN shared IS NULL THEN -8 ELSE [0, 30, 5, 5, 2][shared] END AS shared_name,
    CASE WHEN a.layout IS NULL OR b.layout IS NULL THEN 0 WHEN a.layout = b.layout THEN 15 ELSE -35 END AS layout, CASE WHEN g IS NULL THEN 0 WHEN g <= 0.10 THEN 15 * (1 - g / 0.10) ELSE -25 * least(1.0, (g - 0.10) / 0.20) END AS price,
    CASE WHEN d IS NULL THEN 0 WHEN d <= 2 THEN 10 WHEN d <= 6 THEN 10 * (1 - (d - 2) / 4.0) ELSE -15 * least(1.0, (d - 6) / 10.0) END AS size, t IS NOT NULL OR named AS evidence, coalesce(g <= 0.10, false) AND coalesce(a.layout = b.layout, false) AND coalesce(d <= 6, false) AS agrees FROM x),
  scored AS (SELECT i, j, round(CAST(gps AS DOUBLE) + shared_name + layout + price + size, 4) AS total, evidence, agrees FROM f)"""

FOLD = SCORED.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """,
  known AS (SELECT p_partkey AS ord, (p_partkey % 7 <> 0)::INT + (nullif(p_size, 13) IS NOT NULL)::INT + (p_partkey % 3 <> 0)::INT AS facts FROM part),
  m AS (SELECT i, j, a.facts >= b.facts AS keep_i FROM scored JOIN known a ON a.ord = i JOIN known b ON b.ord = j WHERE evidence AND total >= 55 AND agrees),
  taking AS (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS k FROM m WHERE keep_i GROUP BY i),
  walk(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT t.k, CASE WHEN list_contains(gone, t.i) THEN gone ELSE list_concat(gone, t.js) END FROM walk w JOIN taking t ON t.k = w.k + 1),
  early AS (SELECT DISTINCT unnest(gone) AS r FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
  taken AS (SELECT j AS removed, min(i) AS keeper, min(i) AS turn, j AS other FROM m WHERE keep_i AND i NOT IN (SELECT r FROM early) GROUP BY j),
  own AS (SELECT m.i AS removed, max(m.j) AS keeper, m.i AS turn, min(m.j) AS other FROM m LEFT JOIN taken b ON b.removed = m.j WHERE NOT keep_i AND m.i NOT IN (SELECT r FROM early) AND (b.keeper IS NULL OR b.keeper >= m.i) GROUP BY m.i),
  fold AS (SELECT * FROM taken UNION ALL SELECT * FROM own),
  chain(removed, keeper, turn, other) AS (SELECT * FROM fold UNION ALL SELECT c.removed, f.keeper, c.turn, c.other FROM chain c JOIN fold f ON f.removed = c.keeper),
  final AS (SELECT * FROM chain WHERE keeper NOT IN (SELECT removed FROM fold)),
  src AS (SELECT keeper, a.source, min((turn, other)) AS at FROM final JOIN r a ON a.ord = removed JOIN r b ON b.ord = keeper WHERE a.source <> b.source GROUP BY 1, 2)"""


def to_link(spark, sf_dir):
    k = C("p_partkey")
    tiers = F.array(*(F.lit(t) for t in ("gps", "street", "part", "quarter", "town", "district")))
    name = lambda n: F.struct(n.cast("string").alias("name"), F.when(n >= 200, "town").when(n >= 100, "quarter").when(n % 3 == 0, "part").otherwise("street").alias("tier"))
    names = F.when(k % 5 == 0, F.array().cast("array<struct<name:string,tier:string>>")).when(k % 5 == 1, F.array(name(k % 40), name(100 + k % 9))).otherwise(F.array(name(k % 40), name(200 + k % 4)))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        L("p_partkey").alias("ord"), C("p_brand").alias("source"), F.when(k % 7 != 0, 50.0 + (k % 61) * 0.002).alias("lat"), (14.0 + (k % 53) * 0.003).alias("lon"), F.when(k % 7 != 0, F.element_at(tiers, (1 + k % 6).cast("int"))).alias("tier"), names.alias("names"),
        (k % 5 != 0).alias("has_names"), C("p_type").alias("layout"), F.when(k % 13 != 0, (1000 + k * 37 % 700).cast("long")).alias("price"), F.nullif(C("p_size"), F.lit(13)).alias("size"), F.lit(None).cast("int").alias("land"),
        linkage.completeness(F.when(k % 7 != 0, 1), F.nullif(C("p_size"), F.lit(13)), F.nullif(k % 3, F.lit(0))).alias("facts"))
