"""Registered queries of the register's files, its projection, and nearest points."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from larkspur.functions import projection as p
from larkspur.operators import nearest
from larkspur.plans.catalog import H, registered, table
from larkspur.sources import archives, payloads, state_file
from larkspur.sources.store import store
from larkspur.streaming import scans

C = F.col


def wgs84_sql(rows: str) -> str:
    """rows (with y and x, positive) with lat and lon, step by step."""
    q = f"SELECT *, 2 * atan(pow({p.R0!r} / sqrt(x * x + y * y), {1 / p.N!r}) * {p.CONE!r}) - pi() / 2 AS pt, atan2(y, x) / {p.N!r} AS pd FROM ({rows})"
    q = f"SELECT *, asin({math.cos(math.radians(p.AXIS))!r} * sin(pt) - {math.sin(math.radians(p.AXIS))!r} * cos(pt) * cos(pd)) AS pu FROM ({q})"
    q = f"SELECT *, pow(tan(pu / 2 + pi() / 4), {1 / p.B!r}) * {p.T0 ** (-1 / p.B)!r} AS pk, {math.radians(p.MERIDIAN)!r} - asin(cos(pt) * sin(pd) / cos(pu)) / {p.B!r} AS l, pu AS f0 FROM ({q})"
    for k in range(p.ROUNDS):
        q = f"SELECT *, 2 * atan(pk * exp({p.E!r} * atanh({p.E!r} * sin(f{k})))) - pi() / 2 AS f{k + 1} FROM ({q})"
    q = f"SELECT *, {p.BESSEL[0]!r} / sqrt(1 - {p.E**2!r} * sin(f{p.ROUNDS}) * sin(f{p.ROUNDS})) AS n, f{p.ROUNDS} AS f FROM ({q})"
    q = f"SELECT *, n * cos(f) * cos(l) AS gx, n * cos(f) * sin(l) AS gy, n * {1 - p.E**2!r} * sin(f) AS gz FROM ({q})"
    dx, dy, dz, rx, ry, rz, ppm = p.SHIFT
    rx, ry, rz, m = (*(math.radians(s / 3600) for s in (rx, ry, rz)), 1 + ppm * 1e-6)
    q = f"SELECT *, {dx} + {m!r} * (gx - {rz!r} * gy + {ry!r} * gz) AS wx, {dy} + {m!r} * ({rz!r} * gx + gy - {rx!r} * gz) AS wy, {dz} + {m!r} * (-{ry!r} * gx + {rx!r} * gy + gz) AS wz FROM ({q})"
    a, e2 = p.WGS84[0], p._square(p.WGS84[1])
    b = a * (1 - p.WGS84[1])
    q = f"SELECT *, sqrt(wx * wx + wy * wy) AS wo, atan2(wz * {a!r}, sqrt(wx * wx + wy * wy) * {b!r}) AS ws FROM ({q})"
    return f"SELECT *, degrees(atan2(wz + {e2 / (1 - e2) * b!r} * pow(sin(ws), 3), wo - {e2 * a!r} * pow(cos(ws), 3))) AS lat, degrees(atan2(wy, wx)) AS lon FROM ({q})"


STREETS = "SELECT l_suppkey AS street, 650000.0 + avg(l_extendedprice) AS y, 1050000.0 + 1000 * avg(l_quantity) AS x FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 6 <> 0 GROUP BY 1"


@registered(f"SELECT street, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({wgs84_sql(STREETS)})")
def street_positions(spark, sf_dir):
    """Where streets are: the mean of their located addresses, taken in the plane, then on the globe."""
    located = C("l_returnflag") != "R"
    rows = table(spark, sf_dir, "lineitem").select(F.when(C("l_suppkey") % 6 != 0, C("l_suppkey")).alias("street"), F.when(located, C("l_extendedprice")).alias("y"), F.when(located, C("l_quantity")).alias("x"))
    at = payloads.street_centres(rows).select("street", p.wgs84(650000.0 + C("y"), 1050000.0 + 1000 * C("x")).alias("at"))
    return at.select("street", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


# -- the register's exchange file ------------------------------------------------------------------------------------

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<vf:VymennyFormat xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:vf="urn:cz:isvs:ruian:schemas:VymennyFormatTypy:v1">\n<vf:Hlavicka><vf:VerzeVFR>3.1</vf:VerzeVFR></vf:Hlavicka>\n<vf:Data>'
FOOT = "</vf:Data>\n</vf:VymennyFormat>"
PREFIXES = {"Vusc": "vci", "Okres": "oki", "Orp": "opi", "Pou": "pui", "Obec": "obi", "Mop": "mpi", "Momc": "mci", "CastObce": "coi"}


def write_state_files(rows, folder: str) -> None:
    """Exchange files, one a task, of rows of kind, code, name (null: none), y, x and the parents' codes."""
    own = F.create_map(*(F.lit(v) for kv in PREFIXES.items() for v in kv))[C("kind")]
    tag = lambda prefix, name, inside: F.concat(F.lit("<"), prefix, F.lit(f":{name}>"), inside, F.lit("</"), prefix, F.lit(f":{name}>"))
    escaped = F.replace(F.replace(C("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parents = [F.when(C(k).isNotNull(), tag(own, k, tag(F.lit(PREFIXES[k]), "Kod", C(k).cast("string")))) for k in state_file.PARENTS]
    point = F.format_string('<gml:Point gml:id="D%s.%d"><gml:pos>%.2f %.2f</gml:pos></gml:Point>', "kind", "code", -C("y"), -C("x"))
    inside = F.concat_ws("", tag(own, "Kod", C("code").cast("string")), F.when(C("name").isNotNull(), tag(own, "Nazev", escaped)), *parents, F.when(C("name").isNotNull(), tag(own, "Geometrie", tag(own, "DefinicniBod", point))))
    line = F.concat(F.format_string('<vf:%s gml:id="%s.%d">\n', "kind", "kind", "code"), inside, F.format_string("</vf:%s>", "kind"))

    def file(frames):
        import pandas as pd

        yield pd.DataFrame({"line": [HEAD]})
        last = None
        for frame in frames:
            for kind, part in frame.groupby("kind", sort=False):
                if kind != last:
                    yield pd.DataFrame({"line": [f"</vf:{last}>"] * (last is not None) + [f"<vf:{kind}>"]})
                    last = kind
                yield part[["line"]]
        yield pd.DataFrame({"line": [f"</vf:{last}>"] * (last is not None) + [FOOT]})

    rows.select("kind", line.alias("line")).sortWithinPartitions("kind").mapInPandas(file, "line string").write.text(folder)


UNITS = """SELECT 'Vusc' AS kind, r_regionkey + 1 AS code, r_name AS name, NULL AS up, NULL AS region FROM region
  UNION ALL SELECT 'Okres', 100 + n_nationkey, n_name || ' & <okres>', CAST(n_regionkey + 1 AS VARCHAR), n_regionkey + 1 FROM nation
  UNION ALL SELECT 'Orp', 200 + n_nationkey, NULL, CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_regionkey + 1 AS VARCHAR) ELSE '' END, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey + 1 END FROM nation
  UNION ALL SELECT 'Pou', 300 + n_nationkey, NULL, CAST(200 + n_nationkey AS VARCHAR), NULL FROM nation
  UNION ALL SELECT 'Obec', 1000 + s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE (100 + s_nationkey) || ',' END || (300 + s_nationkey - CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey % 5 ELSE 0 END), (SELECT n_regionkey + 1 FROM nation WHERE n_nationkey = s_nationkey - CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey % 5 ELSE 0 END) FROM supplier
  UNION ALL SELECT 'Mop', 1000000 + c_custkey, c_name, CAST(1000 + c_nationkey AS VARCHAR), NULL FROM customer
  UNION ALL SELECT 'Momc', 2000000 + c_custkey, c_name, (1000 + c_nationkey) || CASE WHEN c_custkey % 3 = 0 THEN ',' || (1000000 + c_custkey) ELSE '' END, NULL FROM customer
  UNION ALL SELECT 'CastObce', 3000000 + p_partkey, p_name, CAST(1000 + p_size AS VARCHAR), NULL FROM part"""


@registered(f"""SELECT kind, CAST(code AS BIGINT) AS code, name, coalesce(up, '') AS parents, CAST(CASE WHEN kind IN ('Okres', 'Orp', 'Obec') THEN region END AS BIGINT) AS region, CASE WHEN name IS NOT NULL THEN round(lat, 6) END AS lat, CASE WHEN name IS NOT NULL THEN round(lon, 6) END AS lon
  FROM ({wgs84_sql(f"SELECT *, 600000.0 + code % 997 * 150 AS y, 1000000.0 + code % 991 * 180 AS x FROM ({UNITS})")})""")
def register_units(spark, sf_dir):
    """The eight tables of exchange files that hold the given tables as territorial units."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None)

    def rows(df, kind, code, name, **parents):
        return df.select(F.lit(kind).alias("kind"), code.cast("long").alias("code"), name.cast("string").alias("name"), *(parents.get(k, none).cast("long").alias(k) for k in state_file.PARENTS))

    nation, customer, k = t("nation"), t("customer"), C("n_nationkey")
    direct = C("s_suppkey") % 7 != 0
    all_ = [
        rows(t("region"), "Vusc", C("r_regionkey") + 1, C("r_name")),
        rows(nation, "Okres", 100 + k, F.concat("n_name", F.lit(" & <okres>")), Vusc=C("n_regionkey") + 1),
        rows(nation, "Orp", 200 + k, none, Vusc=F.when(k % 5 == 0, C("n_regionkey") + 1)),
        rows(nation, "Pou", 300 + k, none, Orp=200 + k),
        rows(t("supplier"), "Obec", 1000 + C("s_suppkey"), C("s_name"), Okres=F.when(direct, 100 + C("s_nationkey")), Pou=300 + C("s_nationkey") - F.when(direct, 0).otherwise(C("s_nationkey") % 5)),
        rows(customer, "Mop", 1_000_000 + C("c_custkey"), C("c_name"), Obec=1000 + C("c_nationkey")),
        rows(customer, "Momc", 2_000_000 + C("c_custkey"), C("c_name"), Obec=1000 + C("c_nationkey"), Mop=F.when(C("c_custkey") % 3 == 0, 1_000_000 + C("c_custkey"))),
        rows(t("part"), "CastObce", 3_000_000 + C("p_partkey"), C("p_name"), Obec=1000 + C("p_size")),
    ]
    whole = all_[0]
    for more in all_[1:]:
        whole = whole.unionByName(more)
    folder = f"{scans.shared_dir(spark)}/state-files-{uuid.uuid4().hex}"
    write_state_files(whole.withColumn("y", 600000.0 + C("code") % 997 * 150).withColumn("x", 1000000.0 + C("code") % 991 * 180), folder)
    out = None
    for kind, own in state_file.tables(state_file.elements(spark, folder)).items():
        parents = [C(c).cast("string") for c in state_file.KINDS[kind] if c in own.columns]
        has = lambda c, kind_: C(c) if c in own.columns else F.lit(None).cast(kind_)  # noqa: B023, E731
        one = own.select(F.lit(kind).alias("kind"), "code", has("name", "string").alias("name"), F.concat_ws(",", *parents).alias("parents"), has("Vusc", "long").alias("region"), has("lat", "double").alias("lat"), has("lon", "double").alias("lon"))
        out = one if out is None else out.unionByName(one)
    return out


@registered("""SELECT CAST(c_custkey AS BIGINT) AS code, c_name || ' "ulice"; Žižkov' || chr(10) || 'é' AS name, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS BIGINT) END AS part, c_mktsegment AS segment FROM customer""")
def zipped_addresses(spark, sf_dir):
    """Rows of separated files in code page 1250 inside archives, which tasks have written from the customers."""
    folder = f"{scans.shared_dir(spark)}/archives-{uuid.uuid4().hex}"

    def pack(frames):
        import csv
        import io
        import zipfile

        import pandas as pd
        from pyspark import TaskContext

        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        end, begun = f"{path}/{TaskContext.get().partitionId():06d}.zip", f"{path}/.{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(begun) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
            for k, frame in enumerate(frames):
                text = io.StringIO()
                rows = csv.writer(text, delimiter=";")
                rows.writerow(["code", "name", "part", "segment"])
                # a missing value is an empty part; a column with one comes as floats
                given = lambda x: not pd.isna(x)
                rows.writerows([code, f'{name} "ulice"; Žižkov\né' if given(name) else "", int(part) if code % 4 and given(part) else "", segment] for code, name, part, segment in frame.itertuples(index=False))
                bundle.writestr(f"{k}.csv", text.getvalue().encode("cp1250"))
                n += len(frame)
        fs.move(begun, end)
        yield pd.DataFrame({"n": [n]})

    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").mapInPandas(pack, "n long").agg(F.sum("n")).collect()
    part = lambda n: F.nullif(C("parts")[n], F.lit(""))
    return archives.zipped_rows(spark, folder).select(part(0).cast("long").alias("code"), part(1).alias("name"), part(2).cast("long").alias("part"), part(3).alias("segment"))


# -- nearest points --------------------------------------------------------------------------------------------------

CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey % 50 > 0 THEN 48.5 + (c_custkey % 2113) * 0.001 END AS lat, 12.1 + (c_custkey % 3313) * 0.002 AS lon FROM customer"
SUPPLIERS = "SELECT s_suppkey AS k, 48.6 + s_suppkey % 37 * 0.05 AS olat, CASE WHEN s_suppkey % 40 > 0 THEN 12.2 + s_suppkey % 41 * 0.15 END AS olon FROM supplier"


@registered(f"""WITH c AS ({CUSTOMERS}), d AS (SELECT c_custkey, k, round(2 * 6371000.0 * asin(sqrt({H.format(a='', b='o')})), 6) AS d FROM c, ({SUPPLIERS}) WHERE lat IS NOT NULL AND olon IS NOT NULL),
  n AS (SELECT c_custkey, arg_min(k, (d, k)) AS place, min(d) AS metres FROM d GROUP BY 1) SELECT c_custkey, CAST(place AS BIGINT) AS place, round(metres, 3) AS metres FROM c LEFT JOIN n USING (c_custkey)""")
def nearest_points(spark, sf_dir):
    """The nearest supplier of each customer; suppliers share positions, and some on either side have none."""
    k, s = C("c_custkey"), C("s_suppkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 50 > 0, 48.5 + (k % 2113) * 0.001).alias("lat"), (12.1 + (k % 3313) * 0.002).alias("lon"))
    places = table(spark, sf_dir, "supplier").select(s.cast("long").alias("s_suppkey"), (48.6 + s % 37 * 0.05).alias("lat"), F.when(s % 40 > 0, 12.2 + s % 41 * 0.15).alias("lon"))
    return nearest.nearest(points, places, "c_custkey", "s_suppkey").select("c_custkey", "place", F.round("metres", 3).alias("metres"))


# -- portals' parameters ---------------------------------------------------------------------------------------------

HEADING, BOX, PAIR = r"<h4>([^<]*)</h4>", r'<input name="regions\[(\d+)\]\[(\d+)\]"[^>]*><label>([^<]*)</label>', r'\{name:"([^"]*)",osmId:"(R\d+)"\}'


@registered("""SELECT 'district' AS kind, CAST(s_suppkey AS BIGINT) AS code, s_name AS name, (s_nationkey + 500) || '/' || s_suppkey AS form, 'R' || s_suppkey AS script FROM supplier
  UNION ALL SELECT 'region', CAST(n_nationkey AS BIGINT), n_name, (n_nationkey + 500) || '/' || coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), ''), 'R' || (1000000 + n_nationkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def portal_index(spark, sf_dir):
    """The parameters by which two portals name nations (with all districts of theirs) and suppliers as districts, out of a form and scripts."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), C("s_nationkey") == C("n_nationkey"))
    box = F.format_string('<input name="regions[%d][%d]" value="on"><label> %s </label>\n', C("n_nationkey") + 500, "s_suppkey", "s_name")
    pair = F.format_string('{name:"%s",osmId:"R%d"}', "s_name", "s_suppkey")
    pages = both.groupBy("n_nationkey", "n_name", F.floor(C("s_suppkey") / 100)).agg(F.array_join(F.collect_list(box), "").alias("boxes"), F.array_join(F.collect_list(pair), ",").alias("pairs"))
    pages = pages.select(F.concat(F.lit("<form><h4> "), "n_name", F.lit(" </h4>"), "boxes", F.lit("</form>")).alias("html"), F.concat(F.lit("var t=["), F.format_string('{name:"%s",osmId:"R%d"},', "n_name", C("n_nationkey") + 1000000), "pairs", F.lit("];")).alias("script"))
    items = payloads.headed_items(pages, "html", HEADING, BOX).withColumn("label", F.trim("g3"))
    districts = items.select(F.lit("district").alias("kind"), C("label").alias("name"), F.concat_ws("/", "g1", "g2").alias("id"))
    numbers = F.array_join(F.transform(F.array_sort(F.collect_set(C("g2").cast("long"))), lambda x: x.cast("string")), ",")
    regions = items.groupBy(C("heading").alias("name"), "g1").agg(numbers.alias("all")).select(F.lit("region").alias("kind"), "name", F.concat_ws("/", "g1", "all").alias("id"))
    region_names = table(spark, sf_dir, "nation").select(C("n_name").alias("g1"), F.lit("region").alias("is"))
    script = payloads.script_pairs(pages, "script", PAIR).join(F.broadcast(region_names), "g1", "left").select(F.coalesce("is", F.lit("district")).alias("kind"), C("g1").alias("name"), C("g2").alias("id"))
    units = both.select(F.lit("district").alias("kind"), C("s_suppkey").cast("long").alias("code"), C("s_name").alias("name")).union(both.select(F.lit("region"), C("n_nationkey").cast("long"), "n_name").distinct())
    return payloads.parameter_index(units, form=districts.unionByName(regions), script=script).select("kind", "code", "name", "form", "script")
