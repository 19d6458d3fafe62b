"""Incremental cleaning of arriving documents; an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean


def clean_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Clean new Parquet files as they arrive; exactly once, by the checkpoint."""
    rows = clean(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
