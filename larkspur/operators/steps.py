"""Tables between the rounds of a loop, in the shared folder: lineage stays short and a lost executor costs a task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.streaming.scans import shared_dir


class Steps:
    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        """df, as a table of its own."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """df, as a table that stays, while all others are deleted."""
        path = f"{self.folder}-result"
        df.write.parquet(path)
        home = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        home.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(home, True)
        return self.spark.read.schema(df.schema).parquet(path)
