"""Pixel and tile tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pixels(pixels: DataFrame, path: str, raster_id: str = "raster_id") -> None:
    """Pixels partitioned by raster and sorted by cell, so window reads prune row groups."""
    pixels.repartitionByRange(F.col(raster_id), F.col("row_idx")).sortWithinPartitions(raster_id, "row_idx", "col_idx").write.mode("overwrite").partitionBy(raster_id).parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_tiles(pixels_long: DataFrame, block: int) -> DataFrame:
    """``(band, tile_row, tile_col, height, width, data)``: arrays in row order.

    A tile has at most ``block`` squared cells, so its list is bounded.
    """
    keys = {"tile_row": F.floor(F.col("row_idx") / block), "tile_col": F.floor(F.col("col_idx") / block)}
    cells = F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "value")))
    tiles = pixels_long.withColumns(keys).groupBy("band", "tile_row", "tile_col").agg(cells.alias("s"))
    size = lambda c: (F.array_max(F.col(f"s.{c}")) - F.array_min(F.col(f"s.{c}")) + 1).cast("int")
    return tiles.select("band", "tile_row", "tile_col", size("row_idx").alias("height"), size("col_idx").alias("width"), F.col("s.value").alias("data"))


def from_tiles(tiles: DataFrame, block: int) -> DataFrame:
    """Long pixels of full tiles."""
    out = tiles.select("band", "tile_row", "tile_col", "width", F.posexplode("data").alias("pos", "value"))
    row, col = F.col("tile_row") * block + F.floor(F.col("pos") / F.col("width")), F.col("tile_col") * block + F.col("pos") % F.col("width")
    return out.select("band", row.alias("row_idx"), col.alias("col_idx"), "value")
