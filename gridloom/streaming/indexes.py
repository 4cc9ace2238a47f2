"""Pixels that arrive as files, indexed as they come.

The batch expressions apply unchanged to a stream: no state, no shuffle, each
file is handled once and its rows leave in the same micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.raster import FILL, add_indexes, apply_mask, mask_values


def pixel_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet pixel files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def indexed(pixels: DataFrame, bands: list[str], indexes: dict, mask_band: str | None = None, masked: list[int] | None = None) -> DataFrame:
    """The batch projection: optional mask with 9999, then the index columns."""
    if mask_band is not None:
        pixels = apply_mask(pixels, bands, mask_values(mask_band, masked or []), FILL)
    return add_indexes(pixels, indexes)


def write_stream(pixels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet what is available now, exactly once, then stop."""
    return pixels.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
