"""The shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a new temporary folder, set for the session so that
    checkpoint() uses it too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here, and a lost executor loses nothing."""
    return written(df, new_folder(df.sparkSession, name))


class Scratch:
    """Tables of one job in the shared folder: put() writes one and reads it again, drop() deletes those that nothing reads
    any more, so that rounds don't add up on disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, new_folder(spark, name), set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        return written(df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in self.names.intersection(names):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*self.names.difference(names))
