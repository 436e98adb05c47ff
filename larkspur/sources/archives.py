"""Rows of separated text files inside zip archives, a task for each member, read in bounded chunks.

A member is unpacked, decoded and split as a stream, so a task holds a batch of rows, however large the member; quoted separators and line
ends, and characters that straddle two chunks, come out as the csv module reads them.

Defined results: the first row of each member is its header and left out (``header``); rows are arrays of text in file order, with archive,
member and place (from 0); a blank line is a row without parts; members that are folders are left out; an empty member gives none.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.sources.store import files, store

SCHEMA = "archive string, member string, place long, parts array<string>"
#: Rows that a task holds.
BATCH = 10_000


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        super().__init__((archive, member))
        self.archive, self.member = archive, member


class ZippedRowsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.separator, self.encoding = options["folder"], options.get("separator", ";"), options.get("encoding", "cp1250")
        self.header = options.get("header", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = []
        for archive in files(self.path, ".zip"):
            fs, path = store(archive)
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as bundle:  # the directory of the archive alone
                found += [Member(archive, i.filename) for i in bundle.infolist() if not i.is_dir()]
        return found or [Member("", "")]

    def read(self, partition: Member):
        if not partition.archive:
            return
        fs, path = store(partition.archive)
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("parts", pa.list_(pa.string()))])
        with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as bundle, bundle.open(partition.member) as member:
            rows = csv.reader(io.TextIOWrapper(member, encoding=self.encoding, newline=""), delimiter=self.separator)
            if self.header:
                next(rows, None)
            place, held = 0, []

            def batch():
                n = len(held)
                return pa.RecordBatch.from_arrays([pa.array([partition.archive] * n), pa.array([partition.member] * n), pa.array(range(place, place + n), pa.int64()), pa.array(held, pa.list_(pa.string()))], schema=schema)

            for row in rows:
                held.append(row)
                if len(held) == BATCH:
                    yield batch()
                    place, held = place + len(held), []
            if held:
                yield batch()


class ZippedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZippedRowsReader(dict(self.options))


def zipped_rows(spark: SparkSession, path: str, separator: str = ";", encoding: str = "cp1250", header: bool = True) -> DataFrame:
    """archive, member, place and parts of all rows of all members of an archive, or of the archives of a folder."""
    spark.dataSource.register(ZippedRows)
    return spark.read.format("zipped_rows").options(folder=path, separator=separator, encoding=encoding, header=str(header).lower()).load()
