from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkspur.operators import state
from larkspur.sources import pages
from larkspur.streaming import scans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pages(spark):
    html = F.lit('<title>A &amp; B</title><a class="x" href="/1">1</a><a href="/2">2</a><a href="/1">1</a><div class="card" data-price="5"></div><script id="data" type="j">{"a": 1}</script>')
    assert one(spark, pages.title(html)) == "A &amp; B" and one(spark, pages.title(F.lit("none"))) is None
    assert one(spark, pages.links(html)) == ["/1", "/2"]
    assert one(spark, pages.attributes(html, "div", "data-price")) == ["5"]
    assert one(spark, pages.embedded_json(html, "data")) == '{"a": 1}' and one(spark, pages.embedded_json(html, "no")) is None
    ok = lambda u: one(spark, pages.allowed_url(F.lit(u), "x.example", "/private"))
    assert ok("https://x.example/a") and not ok("https://x.example/private/a") and not ok("https://y.example/a") and not ok("junk")


def test_first_wins_and_paging_stops_at_a_page_without_a_new_id(spark):
    hits = spark.createDataFrame([("a", 1, "i"), ("a", 1, "j"), ("a", 2, "j"), ("a", 3, "k")], "source string, page int, id string")
    assert [tuple(r) for r in pages.new_per_page(hits, "source", "page", "id").orderBy("page").collect()] == [("a", 1, 2, False), ("a", 2, 0, True), ("a", 3, 1, False)]
    assert sorted(r.page for r in pages.first_of_each(hits, "id", "page").collect()) == [1, 1, 3]


def test_a_source_that_fails_midway_leaves_the_others_readable(spark):
    def broken():
        raise OSError("no answer")

    def midway():
        return spark.createDataFrame([(1, "3"), (2, "x")], "id long, v string").select("id", F.expr("CAST(v AS INT)").alias("v"))

    make = lambda rows, kind="id long": (lambda: spark.createDataFrame(rows, kind))
    readers = {"a": make([(7,), (1,)]), "b": broken, "c": make([(2, "x")], "id long, more string"), "d": midway, "e": make([]), "off": make([(9,)])}
    rows, health = pages.read_sources(spark, readers, ["e", "d", "c", "b", "a"])
    assert [(r.source, r.source_rank, r.found, r.health) for r in health.orderBy("source_rank").collect()] == [("a", 0, 2, "ok"), ("b", 1, 0, "broken"), ("c", 2, 1, "ok"), ("d", 3, 0, "broken"), ("e", 4, 0, "zero_results")]
    assert [(r.source, r.ord.source_rank, r.id, r.more) for r in rows.orderBy("ord").collect()] == [("a", 0, 7, None), ("a", 0, 1, None), ("c", 2, 2, "x")]
    assert pages.answered(health) and not pages.answered(health.where("source in ('b', 'd')"))
    none, health = pages.read_sources(spark, {"b": broken}, ["b"])
    assert none is None and not pages.answered(health)


def test_first_of_each_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 2, "x"), (None, 1, "y"), ("a", None, "z"), ("a", 1, "w")], "k string, n int, v string")
    assert sorted((str(r.k), r.v) for r in pages.first_of_each(rows, "k", "n").collect()) == [("None", "y"), ("a", "z")]


def test_files_in_a_central_european_code_page(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Kód;Název\n1;Žižkov\n2;Čečelice\nshort\n".encode("cp1250"))
    rows = pages.read_cp1250_rows(spark.read.format("binaryFile").load(str(tmp_path)), 2).collect()
    assert sorted(r.parts for r in rows) == [["1", "Žižkov"], ["2", "Čečelice"]]


def test_a_stream_of_scans_equals_the_batches(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[("a", at(1)), ("b", at(1))], [("a", at(2))], [("c", at(3)), ("a", at(3))]]
    kind = "item string, seen timestamp_ntz"
    table = scans.SnapshotTable(spark, f"{tmp_path}/state", "item string, first_seen timestamp_ntz, last_seen timestamp_ntz, misses long")
    want = table.read()
    for rows in batches:
        scan = spark.createDataFrame(rows, kind)
        want = state.advance_tracking(want, scan, "item", F.lit(max(r[1] for r in rows)).cast("timestamp_ntz"))
        scan.coalesce(1).write.mode("append").parquet(f"{tmp_path}/scans")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/scans")
        scans.track(stream, table, "item", "seen", f"{tmp_path}/offsets").awaitTermination()
    assert table.versions() == [0, 1, 2]
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))


def test_counts_of_a_stream_in_windows(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, m)) for m in (1, 59)] + [("b", dt.datetime(2024, 1, 1, 1, 0))]
    spark.createDataFrame(rows, "source string, seen timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source string, seen timestamp").parquet(f"{tmp_path}/in")
    scans.observed_counts(stream, "seen", "source").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.source, r.observed) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
