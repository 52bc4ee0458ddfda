"""Incremental runs: new files are taken once, results are appended batch by batch, and a restart goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """``transform`` on all Parquet files of ``source`` that no earlier run took, appended to ``target`` as one folder a batch.

    A batch that is run again after a failure replaces its folder, so its rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending(done: DataFrame, wanted: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The rows of ``wanted`` that ``done`` lacks; all of them with ``force``."""
    return wanted if force else wanted.join(done.select(key).distinct(), key, "left_anti")
