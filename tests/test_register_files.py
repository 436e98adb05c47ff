"""The register's exchange files and archives against plain parsers, the projection against a published point, nearest places against all pairs."""

from __future__ import annotations

import csv
import io
import math
import random
import xml.etree.ElementTree as ElementTree
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.functions import projection
from larkspur.operators import nearest
from larkspur.plans import geodata
from larkspur.sources import archives, state_file

NS = {"vf": "urn:cz:isvs:ruian:schemas:VymennyFormatTypy:v1", "gml": "http://www.opengis.net/gml/3.2", **{v: f"urn:{v}" for v in geodata.PREFIXES.values()}}
HEAD = "<?xml version='1.0' encoding='UTF-8'?>\n<vf:VymennyFormat " + " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items()) + ">\n<vf:Hlavicka><vf:Datum>2026-10-01</vf:Datum></vf:Hlavicka><vf:Data>\n"


def element(kind, code, name, parents, rng):
    p = geodata.PREFIXES[kind]
    inside = f"<{p}:Kod>{code}</{p}:Kod>"
    if kind not in state_file.LINKS:
        inside += f"<{p}:Nazev>{name}</{p}:Nazev>"
    for parent, at in parents.items():
        inside += f"<{p}:{parent}><{geodata.PREFIXES[parent]}:Kod>{at}</{geodata.PREFIXES[parent]}:Kod></{p}:{parent}>"
    points = "".join(f"<gml:pos>{-rng.randrange(450_000, 900_000)}.25 {-rng.randrange(950_000, 1_220_000)}.00</gml:pos>" for _ in range(rng.choice([1, 2])))
    if kind not in state_file.LINKS:
        inside += f'<{p}:Geometrie><{p}:DefinicniBod><gml:MultiPoint gml:id="D{code}"><gml:pointMembers>{points}</gml:pointMembers></gml:MultiPoint></{p}:DefinicniBod></{p}:Geometrie>'
    return f'<vf:{kind} gml:id="{kind[:2]}.{code}">{inside}</vf:{kind}>'


def file_of_units(rng, n):
    parts = []
    for kind, parents in state_file.KINDS.items():
        parts.append(f"<vf:{kind}>")
        for k in range(n):
            own = {p: rng.randrange(n) for p in parents}
            if kind == "Obec":
                own.pop("Okres" if k % 4 == 0 else "Pou")
            if kind == "Momc" and k % 2:
                own.pop("Mop")
            parts.append(element(kind, k, f"Ústí &amp; &lt;{kind}&gt; {k}", own, rng) + rng.choice(["", "\n", "  \n"]))
        parts.append(f"</vf:{kind}>")
    return HEAD + "".join(parts) + "</vf:Data></vf:VymennyFormat>"


def test_state_file_equals_a_whole_parse(spark, tmp_path):
    text = file_of_units(random.Random(1), 40)
    (tmp_path / "file.xml").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits, whose ends fall inside elements
    try:
        tables = {k: v.collect() for k, v in state_file.tables(state_file.elements(spark, str(tmp_path))).items()}
        assert state_file.elements(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    root = ElementTree.fromstring(text.encode())
    code = lambda e, path: int(e.find(path, NS).text) if e.find(path, NS) is not None else None
    whole = {kind: [e for e in root.iter(f"{{{NS['vf']}}}{kind}") if e.get(f"{{{NS['gml']}}}id")] for kind in state_file.KINDS}
    for kind, parents in state_file.KINDS.items():
        p, rows = geodata.PREFIXES[kind], {r.code: r for r in tables[kind]}
        assert len(rows) == len(tables[kind]) == len(whole[kind]) == 40
        for e in whole[kind]:
            row = rows[code(e, f"{p}:Kod")]
            for parent in parents:
                assert row[parent] == code(e, f"{p}:{parent}/{geodata.PREFIXES[parent]}:Kod")
            if kind not in state_file.LINKS:
                assert row.name == e.find(f"{p}:Nazev", NS).text
                x, y = (float(v) for v in e.find(".//gml:pos", NS).text.split())
                (at,) = spark.range(1).select(projection.wgs84(F.lit(-x), F.lit(-y)).alias("at")).collect() if row.code < 3 else (None,)
                assert at is None or (round(at["at"].lat, 6), round(at["at"].lon, 6)) == (row.lat, row.lon)
    district = {r.code: r.Vusc for r in tables["Okres"]}
    authority, office = {r.code: r.Vusc for r in tables["Orp"]}, {r.code: r.Orp for r in tables["Pou"]}
    assert all(r.Vusc == (district[r.Okres] if r.Okres is not None else authority[office[r.Pou]]) for r in tables["Obec"])


@pytest.mark.parametrize("body,what", [("<mpi:Nazev>x</mpi:Nazev>", "code"), ("<mpi:Kod>1</mpi:Kod>", "name"), ("<mpi:Kod>1</mpi:Kod><mpi:Nazev>x</mpi:Nazev>", "point")])
def test_elements_that_lack_something_are_named(spark, tmp_path, body, what):
    (tmp_path / "f.xml").write_text(HEAD + f'<vf:Mop><vf:Mop gml:id="MP.9">{body}</vf:Mop></vf:Mop></vf:Data></vf:VymennyFormat>')
    found = state_file.elements(spark, str(tmp_path))
    with pytest.raises(Exception, match=f"MP.9 has no {what}"):
        state_file.units(found).collect()
    assert len(state_file.units(found, strict=False).collect()) == 1


def test_empty_state_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("")
    (tmp_path / "b.xml").write_text(HEAD + "<vf:Obec></vf:Obec></vf:Data></vf:VymennyFormat>")
    assert all(not t.collect() for t in state_file.tables(state_file.elements(spark, str(tmp_path))).values())


def test_projection_of_the_published_point(spark):
    at = spark.range(1).select(projection.bessel(F.lit(568990.997), F.lit(1050538.634)).alias("b"), projection.wgs84(F.lit(None).cast("double"), F.lit(1.0)).alias("none")).first()
    assert math.degrees(at.b.lat) == pytest.approx(50 + 12 / 60 + 32.442 / 3600, abs=1e-6)
    assert math.degrees(at.b.lon) == pytest.approx(16 + 50 / 60 + 59.179 / 3600, abs=1e-6)
    assert at.none is None


def test_shift_is_near_the_plain_one(spark, monkeypatch):
    points = spark.createDataFrame([(y * 1000.0, x * 1000.0) for y in (450, 600, 743, 900) for x in (950, 1043, 1200)], "y double, x double")
    fine = points.select(projection.wgs84(F.col("y"), F.col("x")).alias("p")).select("p.*").collect()
    monkeypatch.setattr(projection, "SHIFT", (589, 76, 480, 0, 0, 0, 0))
    plain = points.select(projection.wgs84(F.col("y"), F.col("x")).alias("p")).select("p.*").collect()
    assert all(abs(a.lat - b.lat) < 2e-4 and abs(a.lon - b.lon) < 2e-4 for a, b in zip(fine, plain))  # three figures are good to some ten metres


def test_archives_equal_the_csv_module(spark, tmp_path):
    rng, whole = random.Random(2), {}
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as bundle:
            bundle.writestr("folder/", "")
            for m, n in (("small.csv", 3), ("large.csv", 60_000 if a else 10_001), ("header.csv", 0), ("empty.csv", None)):
                text = io.StringIO()
                rows = csv.writer(text, delimiter=";")
                if n is not None:
                    rows.writerow(["code", "name"])
                    rows.writerows([str(k), rng.choice(["Žižkov", 'a "b"', "x;y", "two\r\nlines", "", "ěščř" * 20])] for k in range(n))
                raw = text.getvalue().encode("cp1250")
                bundle.writestr(m, raw)
                whole[a, m] = list(csv.reader(io.TextIOWrapper(io.BytesIO(raw), encoding="cp1250", newline=""), delimiter=";"))[1:]
    df = archives.zipped_rows(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 8
    got = {}
    for r in df.orderBy("place").collect():
        got.setdefault((int(r.archive[-5]), r.member), []).append(list(r.parts))
    assert got == {k: v for k, v in whole.items() if v}
    assert archives.zipped_rows(spark, str(tmp_path / "0.zip"), header=False).where("member = 'header.csv'").first().parts == ["code", "name"]


def metres(a, b):
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    h = half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1])
    return round(2 * 6_371_000.0 * math.asin(math.sqrt(h)), 6)


@pytest.mark.parametrize("seed,leaf", [(1, 1), (2, 4), (3, 32)])
def test_nearest_place_equals_all_pairs(spark, seed, leaf):
    rng = random.Random(seed)
    spots = [(rng.uniform(-60, 70), rng.uniform(-180, 180)) for _ in range(3)]
    near = lambda: (lambda s: (s[0] + rng.gauss(0, 0.01), s[1] + rng.gauss(0, 0.01)))(rng.choice(spots))
    anywhere = lambda: (rng.uniform(-89, 89), rng.choice([rng.uniform(-180, 180), 179.99, -179.99]))
    places = [(k, *(near() if k % 3 else anywhere())) for k in range(150)]
    places += [(200 + k, *places[k][1:]) for k in range(30)] + [(300, None, 1.0), (301, 1.0, None)]
    points = [(k, *(near() if k % 2 else anywhere())) for k in range(120)] + [(500, *places[5][1:]), (501, None, None), (502, 89.999, 0.0), (0, 1.0, 2.0)]
    a = spark.createDataFrame(points, "id long, lat double, lon double").withColumn("cell", F.lit("own"))
    out = nearest.nearest(a, spark.createDataFrame(places, "pid long, lat double, lon double"), "id", "pid", leaf=leaf)
    assert out.columns == ["id", "lat", "lon", "cell", "place", "metres"]
    got = sorted((str(r.id), str(r.lat), r.place, r.metres) for r in out.collect())
    want = []
    for i, lat, lon in points:
        best = min(((metres((lat, lon), p[1:]), p[0]) for p in places if None not in p), default=(None, None)) if lat is not None else (None, None)
        want.append((str(i), str(lat), best[1], best[0]))
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] is w[3] or g[3] == pytest.approx(w[3], abs=1e-5) for g, w in zip(got, want))


def test_nearest_without_places_or_points(spark):
    none = spark.createDataFrame([], "pid long, lat double, lon double")
    one = spark.createDataFrame([(1, 50.0, 14.0)], "id long, lat double, lon double")
    assert [(r.place, r.metres) for r in nearest.nearest(one, none, "id", "pid").collect()] == [(None, None)]
    assert nearest.nearest(one.limit(0), none.unionByName(one.withColumnRenamed("id", "pid")), "id", "pid").collect() == []


def test_nearest_has_no_pairs_of_all(spark):
    points = spark.range(4000).select("id", (F.col("id") % 200 * 0.01).alias("lat"), (F.col("id") % 20 * 0.01).alias("lon"))
    out = nearest.nearest(points, points.withColumnRenamed("id", "pid"), "id", "pid")
    assert out.where("metres > 0").count() == 0 and out.count() == 4000


def test_items_of_a_form_belong_to_the_heading_before_them(spark):
    from larkspur.sources import payloads

    html = '<input name="regions[1][1]" x><label>early</label><h4> A </h4><input name="regions[1][2]"><label>one</label>\n<input name="regions[1][3]" on><label>two</label><h4>B</h4><p>(none)</p><h4>C</h4><input name="regions[9][4]"><label>x y</label>'
    pages = spark.createDataFrame([(7, html), (8, ""), (9, None)], "id long, html string")
    got = [(r.id, r.heading, r.g1, r.g2, r.g3) for r in payloads.headed_items(pages, "html", geodata.HEADING, geodata.BOX, "id").orderBy("place").collect()]
    assert got == [(7, None, "1", "1", "early"), (7, "A", "1", "2", "one"), (7, "A", "1", "3", "two"), (7, "C", "9", "4", "x y")]
    text = spark.createDataFrame([('var t=[{name:"Praha 1",osmId:"R12"},{name:"x"},{name:"Brno",osmId:"R3"}]',)], "t string")
    assert [(r.g1, r.g2) for r in payloads.script_pairs(text, "t", geodata.PAIR).orderBy("place").collect()] == [("Praha 1", "R12"), ("Brno", "R3")]


@pytest.mark.parametrize("rows,what", [([("d", "a", "1")], "d b has no id"), ([("d", "a", "1"), ("d", "a", "2"), ("d", "b", "3")], "d a has several ids"), ([("d", "a", "1"), ("d", "b", "1")], "shares its id")])
def test_an_index_of_parameters_is_total_and_one_to_one(spark, rows, what):
    from larkspur.sources import payloads

    units = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "kind string, code long, name string")
    portal = lambda rows: spark.createDataFrame(rows, "kind string, name string, id string")
    good = portal([("d", "a", "1"), ("d", "a", "1"), ("d", "b", "2"), ("e", "a", "1"), ("d", "unknown", "9")])
    assert sorted((r.code, r.one, r.two) for r in payloads.parameter_index(units, one=good, two=good).collect()) == [(1, "1", "1"), (2, "2", "2")]
    with pytest.raises(Exception, match=what):
        payloads.parameter_index(units, one=good, two=portal(rows)).collect()


def test_archives_of_customers_with_missing_values(spark, tmp_path):
    from larkspur.plans import catalog

    customers = catalog.table(spark, "/root/testdata/sf0.001", "customer")
    missing = lambda c, n: F.when(F.col("c_custkey") % n > 0, F.col(c))
    customers.withColumn("c_nationkey", missing("c_nationkey", 7)).withColumn("c_name", missing("c_name", 11)).write.parquet(f"{tmp_path}/customer.parquet")
    made = catalog.table(spark, tmp_path, "customer")
    found = {r.code: (r.name, r.part, r.segment) for r in catalog.QUERIES["zipped_addresses"](spark, str(tmp_path)).collect()}
    name = lambda n: None if n is None else f'{n} "ulice"; Žižkov\né'
    assert found == {r.c_custkey: (name(r.c_name), r.c_nationkey if r.c_custkey % 4 else None, r.c_mktsegment) for r in made.collect()}
