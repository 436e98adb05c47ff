"""Paged scans against a reader that goes page by page, and commits that die on the way."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import paged
from larkspur.streaming import commit


def in_turn(pages, per_page=None, most=50):
    """(id: result) and the last page of a scan that reads one page after the other."""
    found, last = {}, 0
    for n in range(1, most + 1):
        if n not in pages:
            break
        page, last, known = pages[n], n, len(found)
        for r in page["results"]:
            if r.get("hash_id") is not None:
                found.setdefault(str(r["hash_id"]), (n, r["v"]))
        total, more = page["pagination"].get("total"), page["pagination"].get("next")
        reached = n * per_page if per_page else len(found)
        if not page["results"] or (total is not None and reached >= total) or len(found) == known or more is False:
            break
    return found, last


def stored(folder, sources):
    for name, pages in sources.items():
        for n, page in pages.items():
            own = folder / f"source={name}" / f"range={(n - 1) // paged.RANGE}"
            own.mkdir(parents=True, exist_ok=True)
            with open(own / "part-0.txt", "a") as f:
                f.write(json.dumps({"page": n, **page}, ensure_ascii=False) + "\n")


def made(rng):
    pages = {}
    for n in range(1, rng.choice([3, 10, 60, 70]) + 1):
        results = [{"hash_id": rng.choice([None, rng.randrange(40 * n)]), "v": f"é{n}.{k}"} for k in range(rng.choice([0] + [20] * 40))]
        pages[n] = {"results": results, "pagination": {"total": rng.choice([None, 100, 10_000]), "next": rng.choice([True] * 60 + [False, None])}}
    for n in rng.sample(sorted(pages), k=len(pages) // 10):
        pages[n]["results"] = pages.get(n - 1, pages[n])["results"]  # the same page again
    if rng.random() < 0.2:
        pages.pop(max(2, len(pages) // 2), None)
    return pages


@pytest.mark.parametrize("per_page,most", [(None, 50), (20, 50), (None, 5)])
def test_scans_equal_a_reader_in_turn(spark, tmp_path, per_page, most):
    rng = random.Random(most)
    sources = {f"s {k}": made(rng) for k in range(12)}
    stored(tmp_path, {n.replace(" ", "%20"): p for n, p in sources.items()})
    rows = paged.stored_pages(spark, str(tmp_path), most_pages=most)
    got, last = {}, {r.source: (r.last_page, r.why) for r in paged.stops(rows, per_page, most).collect()}
    for r in paged.paged_scan(rows, per_page, most).collect():
        got.setdefault(r.source, {})[r.id] = (r.page, json.loads(r.result)["v"])
    for name, pages in sources.items():
        found, end = in_turn(pages, per_page, most)
        assert got.get(name, {}) == found and last[name][0] == end
    assert {why for _, why in last.values()} > {"empty", "repeated"} or most == 5


def test_pages_beyond_the_cap_are_not_opened(spark, tmp_path):
    page = lambda n: {"results": [{"hash_id": n, "v": n}], "pagination": {}}
    stored(tmp_path, {"a": {n: page(n) for n in range(1, 101)}})
    (tmp_path / "source=a" / "range=2" / "part-1.txt").write_text("no JSON\n")
    rows = paged.stored_pages(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 50
    assert [(r.last_page, r.why) for r in paged.stops(rows).collect()] == [(50, "cap")]


def test_a_page_of_another_form_is_an_error_that_names_its_source(spark, tmp_path):
    stored(tmp_path, {"good": {1: {"results": [], "pagination": {}}}, "bad": {1: {"items": []}}})
    with pytest.raises(Exception, match="bad: a page lacks results"):
        paged.stored_pages(spark, str(tmp_path)).count()
    assert paged.stored_pages(spark, str(tmp_path), source="good").count() == 1


def test_no_pages(spark, tmp_path):
    assert paged.paged_scan(paged.stored_pages(spark, str(tmp_path))).collect() == []


KIND = "k long, v string"


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    store = commit.Store(spark, f"file://{tmp_path}/store")
    make = lambda v: spark.createDataFrame([(1, v)], KIND)
    assert store.read("a", KIND).collect() == []
    assert store.commit(1, {"a": make("one"), "b": make("one")})
    broken = make("x").withColumn("v", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):
        store.commit(2, {"a": make("two"), "b": broken})  # dies after the first table was written
    now = lambda: [store.read(t, KIND).first().v for t in ("a", "b")]
    assert now() == ["one", "one"] and store.numbers() == [1]
    assert not store.commit(2, {"a": make("dry")}, dry_run=True)
    with pytest.raises(commit.NothingScanned):
        store.commit(2, {"a": make("none")}, answered=False)
    assert now() == ["one", "one"]
    assert store.commit(2, {"a": make("two")}) and now() == ["two", "one"]
    assert not store.commit(2, {"a": make("again")}) and not store.commit(1, {"a": make("late")}) and now() == ["two", "one"]


def test_old_versions_go_but_those_of_the_last_manifests(spark, tmp_path):
    store = commit.Store(spark, str(tmp_path / "store"))
    before = None
    for n in range(1, 7):
        store.commit(n, {"a": spark.createDataFrame([(n, "x")], KIND)} | ({"b": spark.createDataFrame([(n, "y")], KIND)} if n == 1 else {}))
        if n == 5:
            before = store.read("a", KIND)
    assert store.numbers() == [4, 5, 6] and before.first().k == 5
    assert len([p for p in (tmp_path / "store" / "a").iterdir() if p.is_dir()]) == 3
    assert store.read("b", KIND).first().k == 1 and store.read("a", KIND, 4).first().k == 4


def test_a_scan_from_its_sources_to_its_commit(spark, tmp_path):
    from larkspur.operators import scan

    kind = "id long, lat double, lon double, tier string, names array<struct<name:string,tier:string>>, has_names boolean, layout string, price long, size int, land int, facts int"
    row = lambda id_, price, facts=1: (id_, 50.0, 14.0, "gps", [("Dlouhá", "street")], True, "2+kk", price, 50, None, facts)
    far = lambda id_, price: (id_, 49.0, 15.0, "gps", [("Krátká", "street")], True, "1+1", price, 30, None, 1)
    make = lambda rows: (lambda: spark.createDataFrame(rows, kind))

    def broken():
        raise OSError("no answer")

    store = commit.Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "id long")

    def run(n, readers, **more):
        return scan.run_scan(store, n, readers, list(readers), "flat", F.lit(f"2026-01-0{n} 08:00:00").cast("timestamp"), none, **more)

    found = run(1, {"a": make([row(1, 100)]), "b": make([row(2, 100, 2), far(3, None)]), "c": broken})
    assert found.status == "partial" and found.committed
    assert {(r.ord % scan.PLACES, tuple(r.sources)) for r in found.survivors.collect()} == {(2, ("a",)), (3, ())}
    assert found.counts.first().asDict() == {"total": 2, "new": 2, "updated": 0, "price_drops": 0, "disappeared": 0}
    again = {"a": make([row(1, 95)]), "b": make([row(2, 95, 2), far(4, 7)])}
    dry = run(2, again, dry_run=True)
    failed = run(2, {"a": broken, "b": broken})
    assert not dry.committed and failed.status == "failed" and failed.counts is None and store.numbers() == [1]
    found = run(2, again)
    assert found.counts.first() == dry.counts.first() and found.counts.first().asDict() == {"total": 2, "new": 1, "updated": 0, "price_drops": 1, "disappeared": 0}
    assert {r.id: r.misses for r in store.read("tracking", scan.tracking_kind("timestamp")).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.id: r.price for r in store.read("prices", scan.PRICES).collect()} == {1: 95, 2: 95, 4: 7}
    assert not run(2, again).committed
    found = run(3, again, keep=F.col("price") > 50)
    assert found.counts.first().total == 1 and {r.id: r.misses for r in store.read("tracking", scan.tracking_kind("timestamp")).collect()} == {1: 0, 2: 0, 3: 2, 4: 1}


def test_ranges_are_single_files_and_share_partitions(spark, tmp_path, monkeypatch):
    rows = spark.range(60_000).repartition(4).selectExpr("id % 30 AS source", "CAST(id div 30 div 20 + 1 AS INT) AS page", "id div 30 % 20 AS place", "named_struct('hash_id', id) AS result", "2000L AS total")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paged.write_pages(rows, f"{tmp_path}/pages", "source", "page", "place", "result", "total")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(list(f.glob("part-*"))) == 1 for f in (tmp_path / "pages").glob("source=*/range=*"))
    monkeypatch.setattr(paged, "MOST_PARTITIONS", 7)
    reader = paged.StoredPagesReader({"folder": f"{tmp_path}/pages"})
    parts = reader.partitions()
    assert len(parts) == 7 and sorted((r.source, r.number) for p in parts for r in p.ranges) == sorted((str(s), k) for s in range(30) for k in (0, 1))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 30 * 1000
