"""Appending new observations to a cube as they arrive, and how many each location has so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def observation_stream(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_to_cube(stream: DataFrame, cube: str, checkpoint: str) -> StreamingQuery:
    """Writes what is new to the cube, by tile, and ends when there is no more. A batch is written once, or not at all."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", cube).option("checkpointLocation", checkpoint).partitionBy("tile").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Observations by window and key; windows are closed when the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
