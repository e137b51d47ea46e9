"""Risk indicators on a stream of pair frames.

The indicator jobs are row-local, so the batch code runs unchanged on a streaming DataFrame: no state,
no watermark, and exactly-once output through the file sink's own log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nearmiss.operators.indicators import risk_scores


def read_pair_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_scores(pairs: DataFrame, names: Sequence[str], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scores every new frame and appends to `path`; with available_now it stops at the end of the input."""
    writer = risk_scores(pairs, names).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
