"""Readers of scanned pages and payloads: what a portal's page, card list or JSON holds, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.steps import Steps


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def links(html: Column) -> Column:
    """Targets of all links in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)))


def attributes(html: Column, tag: str, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf'<{tag}\b[^>]*\s{name}="([^"]*)"'), F.lit(1))


def embedded_json(html: Column, element_id: str) -> Column:
    """The text of a script element of that id; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def allowed_url(url: Column, host: str, *blocked: str) -> Column:
    """True for pages of the host that no blocked prefix covers."""
    path = F.parse_url(url, F.lit("PATH"))
    out = F.coalesce(F.parse_url(url, F.lit("HOST")) == host, F.lit(False))
    for b in blocked:
        out = out & ~F.coalesce(path.startswith(b), F.lit(False))
    return out


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; the order is data, so the result is the same on each run."""
    first = F.min_by(F.struct("*"), F.struct(*order)).alias("_first")
    return rows.groupBy(F.col(key).alias("_key")).agg(first).select("_first.*")


def new_per_page(hits: DataFrame, source: str, page: str, id_: str) -> DataFrame:
    """How many ids of each page no earlier page had, and whether scanning stops there (the first page without a new one)."""
    first = hits.groupBy(source, id_).agg(F.min(page).alias(page)).groupBy(source, page).agg(F.count("*").alias("new_ids"))
    pages = hits.select(source, page).distinct().join(first, [source, page], "left").withColumn("new_ids", F.coalesce("new_ids", F.lit(0)).cast("long"))
    stop = pages.where("new_ids = 0").groupBy(source).agg(F.min(page).alias("_stop"))
    return pages.join(stop, source, "left").select(source, page, "new_ids", (F.coalesce(F.col("_stop") == F.col(page), F.lit(False))).alias("stops"))


def read_cp1250_rows(files: DataFrame, n_columns: int, separator: str = ";") -> DataFrame:
    """Rows of Windows-1250 text files (as read by the binaryFile source), without their header lines: parts array<string>.

    Decoding is by Arrow batches; a file is one value, as the source gives it.
    """

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for content in frame["content"]:
                out += [p for p in (line.split(separator) for line in bytes(content).decode("cp1250").splitlines()[1:]) if len(p) >= n_columns]
            yield pd.DataFrame({"parts": out})

    return files.select("content").mapInPandas(run, "parts array<string>")


def read_sources(spark: SparkSession, readers: dict, enabled: list[str], position: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the enabled sources, each read in a job of its own into the shared folder, and the health of each.

    rows: those of all sources that could be read to their end, with source, and ord, a struct of source_rank (place in the registry) and
    position (by the column of that name, else in the order in which they were read).  None if no source could be read.
    health: source, source_rank, found, health (ok, zero_results or broken) and error.
    """
    steps, out, health = Steps(spark, "sources"), None, []
    for rank, (name, reader) in enumerate(readers.items()):
        if name not in enabled:
            continue
        try:
            rows = reader()
            place = F.col(position) if position else F.monotonically_increasing_id()
            rows = steps.written(rows.withColumn("source", F.lit(name)).withColumn("ord", F.struct(F.lit(rank).alias("source_rank"), place.cast("long").alias("position"))))
            found = rows.count()
        except Exception as error:  # whatever a source's reader raises, here or in a task, is that source's failure
            health.append((name, rank, 0, "broken", str(error).split("\n")[0][:500]))
            continue
        health.append((name, rank, found, "ok" if found else "zero_results", None))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame(health, "source string, source_rank int, found long, health string, error string")


def answered(health: DataFrame) -> bool:
    """Whether any source could be read; without one, nothing may be counted as missed."""
    return not health.where("health <> 'broken'").isEmpty()
