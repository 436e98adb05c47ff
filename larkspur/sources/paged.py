"""Paged scans over stored pages: a source that plans its partitions by page ranges, and the rules by which a scan stops.

Pages lie as JSON lines, one a page, in ``source=<name>/range=<k>``: range k holds the pages from k * ``RANGE`` + 1 on, and is one file.  A
file is a partition; of more than ``MOST_PARTITIONS``, several are.  Files of pages beyond the most that a scan reads are never opened.  Where a scan stops is decided from counts of
each page, not by reading pages in turn.

Defined results: a page without results or pagination is an error that names its source; an empty page is a row without a place; results
without an id count as results but give no row of a scan; pages after a gap are not read; ids are compared as text.
"""

from __future__ import annotations

import io
import json
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.sources.store import files, store

#: Pages of a range.
RANGE = 25
# Fixed value: pages of a source that a scan reads at most.
MOST_PAGES = 50
#: Results that a task holds.
BATCH = 10_000
#: Partitions that a scan is read in at most.
MOST_PARTITIONS = 512
SCHEMA = "source string, page int, place int, total long, has_next boolean, id string, result string"
_AT = re.compile(r"/source=([^/]*)/range=(\d+)/[^/]*$")


class PageRange:
    def __init__(self, source: str, number: int, file: str):
        self.source, self.number, self.file = source, number, file


class PageRanges(InputPartition):
    def __init__(self, number: int, ranges: list[PageRange]):
        super().__init__(number)
        self.ranges = ranges


class StoredPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.key = options["folder"], int(options.get("most_pages", MOST_PAGES)), options.get("id", "hash_id")
        self.only = options.get("source")

    def partitions(self) -> list[InputPartition]:
        found = [PageRange(unquote(m[1]), int(m[2]), f) for f in files(self.folder) if (m := _AT.search(f))]
        planned = [p for p in found if p.number * RANGE < self.most and self.only in (None, p.source)]
        n = min(len(planned), MOST_PARTITIONS)
        return [PageRanges(k, planned[k::n]) for k in range(n)] or [PageRanges(0, [])]

    def _rows(self, part: PageRange):
        fs, path = store(part.file)
        with fs.open_input_stream(path) as raw:
            for line in io.TextIOWrapper(raw, "utf-8"):
                page = json.loads(line)
                if not isinstance(page, dict) or not isinstance(page.get("results"), list) or not isinstance(page.get("pagination"), dict):
                    raise ValueError(f"{part.source}: a page lacks results or pagination")
                if page["page"] > self.most:
                    continue
                about = (part.source, page["page"]), (page["pagination"].get("total"), page["pagination"].get("next"))
                for place, result in enumerate(page["results"]) if page["results"] else ((None, None),):
                    own = (result or {}).get(self.key)
                    yield *about[0], place, *about[1], None if own is None else str(own), None if result is None else json.dumps(result, ensure_ascii=False)

    def read(self, partition: PageRanges):
        kinds = pa.schema([("source", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("has_next", pa.bool_()), ("id", pa.string()), ("result", pa.string())])
        held = []
        for row in (row for part in partition.ranges for row in self._rows(part)):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoredPagesReader(dict(self.options))


def write_pages(results: DataFrame, folder: str, source: str, page: str, place: str, result: str, total: str, has_next: str | None = None) -> None:
    """Store rows of results (a struct; null for an empty page) as pages, each range of a source as one file."""
    next_ = F.first(has_next) if has_next else F.first(F.lit(None).cast("boolean"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col(result).isNotNull(), F.struct(F.col(place).alias("p"), F.col(result).alias("r"))))), lambda x: x["r"])
    pages = results.groupBy(source, page).agg(listed.alias("results"), F.struct(F.first(total).alias("total"), next_.alias("next")).alias("pagination"))
    line = F.to_json(F.struct(F.col(page).alias("page"), "results", "pagination"))
    stored = pages.select(F.col(source).alias("source"), F.floor((F.col(page) - 1) / RANGE).cast("int").alias("range"), line.alias("line"))
    # by range, or each task would write a file for its few pages of every range
    stored.repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "range").write.partitionBy("source", "range").text(folder)


def stored_pages(spark: SparkSession, folder: str, id_: str = "hash_id", most_pages: int = MOST_PAGES, source: str | None = None) -> DataFrame:
    """All results of the pages that a scan may read, of all sources or one."""
    spark.dataSource.register(StoredPages)
    options = {"folder": folder, "id": id_, "most_pages": str(most_pages)} | ({"source": source} if source is not None else {})
    return spark.read.format("stored_pages").options(**options).load()


def stops(rows: DataFrame, per_page: int | None = None, most_pages: int = MOST_PAGES) -> DataFrame:
    """source, the last page that its scan reads, and why: empty, total, repeated (no new id), no_next or cap; end if pages run out.

    The total is reached by distinct ids, or by places up to the page where ``per_page`` is given.  Ids count before any filtering.
    """
    new = rows.where("id is not null").groupBy("source", "id").agg(F.min("page").alias("page")).groupBy("source", "page").agg(F.count("*").alias("new"))
    pages = rows.groupBy("source", "page").agg(F.count("place").alias("results"), F.max("total").alias("total"), F.min("has_next").alias("has_next"))
    pages = pages.join(new, ["source", "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    order = Window.partitionBy("source").orderBy("page")
    pages = pages.withColumn("n", F.row_number().over(order)).where("n = page").withColumn("known", F.sum("new").over(order))
    reached = F.col("page") * per_page if per_page else F.col("known")
    why = F.when(F.col("results") == 0, "empty").when(reached >= F.col("total"), "total").when(F.col("new") == 0, "repeated").when(~F.col("has_next"), "no_next").when(F.col("page") >= most_pages, "cap")
    last = pages.groupBy("source").agg(F.min(F.when(why.isNotNull(), F.struct("page", why.alias("why")))).alias("stop"), F.max("page").alias("end"))
    return last.select("source", F.coalesce("stop.page", "end").alias("last_page"), F.coalesce("stop.why", F.lit("end")).alias("why"))


def paged_scan(rows: DataFrame, per_page: int | None = None, most_pages: int = MOST_PAGES) -> DataFrame:
    """source, id, page, place and result of each id where it comes first, on the pages that the scan reads."""
    read = rows.join(stops(rows, per_page, most_pages), "source").where("page <= last_page and id is not null")
    first = read.groupBy("source", "id").agg(F.min_by(F.struct("page", "place", "result"), F.struct("page", "place")).alias("f"))
    return first.select("source", "id", "f.page", "f.place", "f.result")
