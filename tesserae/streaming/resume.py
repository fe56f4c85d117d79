"""[IO12, 2.10] A resumable scan of arriving shards: what a checkpoint has seen isn't scanned again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scan_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame]) -> int:
    """Scans the Parquet files that came since the last call; returns the number of batches.

    Each batch writes a partition of its own, `epoch`, and replaces it: a batch that is run again after a crash between
    its write and its commit leaves no row twice."""
    schema = spark.read.parquet(folder).schema
    batches = []

    def each(df: DataFrame, epoch: int) -> None:
        scan(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        batches.append(epoch)

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
