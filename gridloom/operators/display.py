"""The tables behind plots: histograms, stretches and recoded classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``(bin, n)`` of equal-width bins over the value range, the last closed.

    Empty bins are left out; nulls do not count; a constant column fills bin 0.
    """
    value = F.col(column).cast("double")
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("one", F.lit(1))
    joined = df.select(value.alias("v")).filter("v is not null").withColumn("one", F.lit(1)).join(F.broadcast(span), "one")  # one row
    at = F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    return joined.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stretch_8bit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..255 by their common maximum, truncated."""
    top = df.agg(F.array_max(F.array(*[F.max(c) for c in columns])).alias("_top")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")  # one row
    return joined.withColumns({c: (255 * F.try_divide(F.col(c).cast("double"), F.col("_top").cast("double"))).cast("int") for c in columns}).drop("_one", "_top")


def recode(value: Column, steps: list[tuple[int, int]]) -> Column:
    """Sequential replacement: each step sees the result of the steps before."""
    for old, new in steps:
        value = F.when(value == old, F.lit(new)).otherwise(value)
    return value


def class_colours(colours: dict[str, tuple[int, tuple[int, int, int]]], shown: list[str]) -> list[tuple[str, int, float, float, float]]:
    """``(class, index, red, green, blue)`` of a plot in the order of its indexes, channels as fractions of 1.

    ``colours`` gives each class its index and its channels 0..255. Classes that
    are not shown are white; an unknown shown class is a ``ValueError``.
    """
    if unknown := [c for c in shown if c not in colours]:
        raise ValueError(f"unknown classes {unknown}")
    return [(name, index, *(v / 255.0 if name in shown else 1.0 for v in channels)) for name, (index, channels) in sorted(colours.items(), key=lambda c: c[1][0])]


def class_plot(pixels: DataFrame, value: str, labels: dict[str, int], colours: dict[str, tuple[int, tuple[int, int, int]]], shown: list[str]) -> DataFrame:
    """Pixels with the plot index and colour of their class.

    Labels are replaced by indexes one class after the other, in the order of
    ``colours``, so an index may be replaced again by a later class's. An index
    beyond the table is white.
    """
    at = recode(F.col(value), [(labels[name], index) for name, (index, _) in colours.items()])
    table = {index: rgb for _, index, *rgb in class_colours(colours, shown)}
    white = F.array(*[F.lit(1.0)] * 3)
    colour = white
    for index, rgb in table.items():
        colour = F.when(F.col("index") == index, F.array(*map(F.lit, rgb))).otherwise(colour)
    return pixels.withColumn("index", at.cast("int")).withColumn("colour", colour)


def plot_extent(grids: DataFrame) -> DataFrame:
    """``(raster_id, left, right, bottom, top)``: where a raster lies under points on one plot."""
    from gridloom.operators.grid import with_bounds

    return with_bounds(grids).select("raster_id", "left", "right", "bottom", "top")


def image(pixels: DataFrame, bands: list[str], order: list[int], nodata: float | None) -> DataFrame:
    """Bands in a new order (as numbered from 1), nodata as null, stretched to 0..255 together."""
    from gridloom.operators.raster import masked_read, select_bands

    chosen = select_bands(masked_read(pixels, bands, nodata), bands, order)
    return stretch_8bit(chosen, [c for c in chosen.columns if c not in ("row_idx", "col_idx")])


def unit_colours(colour: Column) -> Column:
    """Channels 0..255 as fractions of 1."""
    return F.transform(colour, lambda v: v / F.lit(255.0))
