"""Scans as a stream: each micro-batch is a scan that advances a snapshot table, and windowed counts over observations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.state import advance_tracking

#: Versions of a snapshot table that stay, for readers that began before the last write.
KEPT = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


class SnapshotTable:
    """A table in numbered version folders; a version counts once its _SUCCESS file is there, so readers see whole scans."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))

    def read(self) -> DataFrame:
        found = self.versions()
        # readers that began before a write still find their version
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        """Write a version; the same version again replaces it, so a repeated micro-batch changes nothing.  Old versions are deleted."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        fs, _ = self._fs()
        for old in self.versions()[:-KEPT]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v={old}"), True)


def track(stream: DataFrame, table: SnapshotTable, key: str, at: str, checkpoint: str):
    """Start a query that advances tracking with each micro-batch (processing what is there, then ending).

    The clock of a scan is the latest event time in it, so a replay gives the same state.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if any(number <= v for v in table.versions()):
            return  # this batch was written before a restart
        before = table.read()
        now = batch.agg(F.max(at).alias("at")).first().at
        if now is not None:
            table.write(advance_tracking(before, batch, key, F.lit(now).cast(before.schema["first_seen"].dataType)), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed_counts(stream: DataFrame, at: str, source: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Observations of each source in tumbling windows, late ones up to a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), source).agg(F.count("*").alias("observed")).select(F.col("window.start").alias("start"), source, "observed")
