"""Intermediate tables in the session's shared folder: what an executor loses is read again from there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from usagelens.llm.common import shared_folder


class Scratch:
    """Tables of one run. Those that a later one replaces are dropped once that one is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.place = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def save_and_count(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
        """The saved table and aggregates over its rows, from one job."""
        seen = Observation(name)
        saved = self.save(df.observe(seen, *[column.alias(key) for key, column in counts.items()]), name)
        return saved, seen.get

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
