"""One commit over several tables: all versions are written aside, and one manifest, renamed last, makes them the current ones.

Readers follow the newest manifest, so they see all tables of a scan or none; a run that dies before the rename leaves the state before.
A number that has a manifest is never written again, so a repeated run changes nothing.  Tables that a commit leaves out stay as they were.
Versions that none of the last ``KEPT`` manifests names are deleted after a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Manifests that stay, and with them the versions they name, for readers that began before.
KEPT = 3


class NothingScanned(Exception):
    """No source answered: a commit would count everything as missed."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all commits that still have a manifest."""
        fs, path = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """Folder of each table, by a commit (the newest)."""
        found = self.numbers()
        if not found:
            return {}
        stream = self._fs().open(self._path("manifests", f"{found[-1] if number is None else number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, schema: str, number: int | None = None) -> DataFrame:
        """A table as of a commit (the newest); empty before its first one."""
        own = self.manifest(number).get(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{own}") if own else self.spark.createDataFrame([], schema)

    def commit(self, number: int, tables: dict[str, DataFrame], answered: bool = True, dry_run: bool = False) -> bool:
        """Write the tables as commit ``number``; False if nothing was written, by ``dry_run`` or because it is there already."""
        if not answered:
            raise NothingScanned(f"commit {number}: no source answered")
        known = self.numbers()
        if dry_run or number in known or (known and number < known[-1]):
            return False
        listed = self.manifest()
        for name, df in tables.items():
            own = f"{name}/{number:08d}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{own}")
            listed[name] = own
        fs, begun = self._fs(), self._path("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(begun)
        try:
            out.write(bytearray(json.dumps(listed).encode()))
        finally:
            out.close()
        end = self._path("manifests", f"{number:08d}.json")
        if fs.exists(end) or not fs.rename(begun, end):
            fs.delete(begun, False)
            return False
        self._clear()
        return True

    def _clear(self) -> None:
        fs, numbers = self._fs(), self.numbers()
        named = {own for n in numbers[-KEPT:] for own in self.manifest(n).values()}
        for n in numbers[:-KEPT]:
            fs.delete(self._path("manifests", f"{n:08d}.json"), False)
        for kind in fs.listStatus(self._path()):
            name = kind.getPath().getName()
            for version in fs.listStatus(kind.getPath()) if kind.isDirectory() and name != "manifests" else ():
                own = f"{name}/{version.getPath().getName()}"
                # versions of later numbers may be those of a run that has not ended
                if own not in named and int(version.getPath().getName()[:8]) <= numbers[-1]:
                    fs.delete(version.getPath(), True)
