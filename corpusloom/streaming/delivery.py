"""Notifications of a stream of monitor runs, written once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators.registry import notifications


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """The rows of one micro-batch as the folder of its number.

    Spark gives a batch that it has to repeat the same number and the same rows, so the
    folder is replaced by its equal and nothing is told twice."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def deliver(runs: DataFrame, path: str, checkpoint: str, only_on_change: Column, **trigger) -> StreamingQuery:
    """Start writing the notifications of streamed runs below ``path``; checkpoint and path
    lie in a shared store, and a query that is started again goes on after its last batch."""
    told = notifications(runs, only_on_change)
    return (told.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def delivered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All notifications written so far, with the number of their batch."""
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).option("basePath", path).parquet(path)
