"""Grid metadata: footprints, windows, blocks and extents as columns.

A grid row has ``raster_id, a, e, c, f, width, height`` (pixel size, origin and
size); ``e`` is negative. Every operator returns new columns, none changes a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bounds(grids: DataFrame) -> DataFrame:
    """Adds left, bottom, right and top."""
    c = F.col
    return grids.withColumns({"left": c("c"), "bottom": c("f") + c("e") * c("height"), "right": c("c") + c("a") * c("width"), "top": c("f")})


def window_grid(grids: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """The grid of a pixel window: origin moved, size set."""
    return grids.withColumns({"c": F.col("c") + F.col("a") * col_off, "f": F.col("f") + F.col("e") * row_off, "width": F.lit(width), "height": F.lit(height)})


def resampled_grid(grids: DataFrame, scale: float) -> DataFrame:
    """The grid of a raster resampled by ``scale``: pixels smaller, more of them."""
    out = {"a": F.col("a") / scale, "e": F.col("e") / scale}
    return grids.withColumns(out | {k: F.floor(F.col(k) * scale).cast("int") for k in ("width", "height")})


def crop_window(grids: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """The smallest window of each grid that holds a polygon, rounded outward and cut to the grid.

    Adds col_off, row_off, and sets c, f, width and height; grids that the
    polygon does not meet are left out.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    cols = [(F.lit(x) - F.col("c")) / F.col("a") for x in (min(xs), max(xs))]
    rows = [(F.lit(y) - F.col("f")) / F.col("e") for y in (max(ys), min(ys))]
    out = grids.withColumns({
        "col_off": F.greatest(F.floor(cols[0]).cast("int"), F.lit(0)), "row_off": F.greatest(F.floor(rows[0]).cast("int"), F.lit(0)),
        "_right": F.least(F.ceil(cols[1]).cast("int"), F.col("width")), "_bottom": F.least(F.ceil(rows[1]).cast("int"), F.col("height")),
    }).filter("_right > col_off and _bottom > row_off")
    return out.withColumns({
        "c": F.col("c") + F.col("a") * F.col("col_off"), "f": F.col("f") + F.col("e") * F.col("row_off"),
        "width": F.col("_right") - F.col("col_off"), "height": F.col("_bottom") - F.col("row_off"),
    }).drop("_right", "_bottom")


def set_metadata(grids: DataFrame, **values) -> DataFrame:
    """Grids with some metadata overwritten; an unknown name is a ``ValueError``."""
    unknown = [k for k in values if k not in grids.columns]
    if unknown:
        raise ValueError(f"unknown metadata {unknown}")
    return grids.withColumns({k: F.lit(v) for k, v in values.items()})


def block_windows(grids: DataFrame, block: int) -> DataFrame:
    """One row per block of at most ``block`` x ``block`` pixels, in row order."""
    rows = F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / block).cast("int")))
    out = grids.filter("width > 0 and height > 0").withColumn("tile_row", rows)
    out = out.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / block).cast("int"))))
    return out.select(
        "raster_id", "tile_row", "tile_col", (F.col("tile_row") * block).alias("row_off"), (F.col("tile_col") * block).alias("col_off"),
        F.least(F.lit(block), F.col("height") - F.col("tile_row") * block).alias("height"), F.least(F.lit(block), F.col("width") - F.col("tile_col") * block).alias("width"),
    )


def union_extent(grids: DataFrame) -> DataFrame:
    """One row with the bounds that hold all grids; partial minima before the shuffle."""
    return with_bounds(grids).agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))


def total_bounds(points: DataFrame) -> DataFrame:
    """The box around all points."""
    return points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def cell_of(x: Column, y: Column, a: float, e: float, c: float, f: float) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a point."""
    return F.floor((y - f) / e), F.floor((x - c) / a)


def centre_of(row: Column, col: Column, a: float, e: float, c: float, f: float) -> tuple[Column, Column]:
    """x and y of a pixel's centre."""
    return c + (col + 0.5) * a, f + (row + 0.5) * e


def boxes_meet(l1, b1, r1, t1, l2, b2, r2, t2) -> Column:
    """Do two closed boxes intersect? Touching counts."""
    return (l1 <= r2) & (l2 <= r1) & (b1 <= t2) & (b2 <= t1)


def strictly_within(x: Column, y: Column, left, bottom, right, top) -> Column:
    """Is a point inside a box, its border not included?"""
    return (x > left) & (x < right) & (y > bottom) & (y < top)
