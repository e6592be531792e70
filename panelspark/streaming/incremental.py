"""Incremental runs: files that are new since the last run go through a batch job, and rows already stored are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators.tasks import unseen


def ingest_new(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str, job: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Run job over the Parquet files that source got since the last run and append to store what its keys lack.

    Files are tracked by the stream's checkpoint; a batch that is run again after a failure adds nothing twice, as its keys
    are in the store by then. Rows of one batch that repeat a key are kept once.
    """

    def append(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            new = unseen(new, spark.read.parquet(store), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        job(new).write.mode("append").parquet(store)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(append).start().awaitTermination()
