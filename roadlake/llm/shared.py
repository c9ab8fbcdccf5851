"""The shared folder, tables that cut lineage, and reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one is set only where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roadlake-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables of one operator call in the shared folder. ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.count = spark, new_path(spark, what), 0

    def cut(self, df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
        """Write a table and read it again: its lineage ends there, and a lost executor loses none of it."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        with conf(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # Spark deletes a query's shuffle files when it ends
            df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, table._scratch_path)  # noqa: SLF001


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
