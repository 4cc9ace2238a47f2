"""Operators on pixel tables ``(raster_id?, row_idx, col_idx, band columns...)``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import parse_polygon
from gridloom.functions.numeric import in_region, index_column
from gridloom.operators.grid import centre_of, with_bounds

CELL = ["row_idx", "col_idx"]
#: Scene classes that hide the ground, and what masked pixels hold.
CLOUD_CLASSES, FILL = [3, 7, 8, 9, 10], 9999


def masked_read(pixels: DataFrame, bands: list[str], nodata: float | None) -> DataFrame:
    """Nodata becomes null; without a nodata value nothing changes."""
    if nodata is None:
        return pixels
    return pixels.withColumns({b: F.when(F.col(b) != nodata, F.col(b)) for b in bands})


def select_bands(pixels: DataFrame, bands: list[str], order: list[int]) -> DataFrame:
    """The bands numbered (from 1) in ``order``; only they are scanned. A number
    may be left out or repeated (a repeated one gets a suffix)."""
    seen: dict[str, int] = {}
    columns = []
    for i in order:
        if not 1 <= i <= len(bands):
            raise ValueError(f"band {i} of {len(bands)}")
        name = bands[i - 1]
        seen[name] = seen.get(name, 0) + 1
        columns.append(F.col(name).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return pixels.select(*CELL, *columns)


def window(pixels: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """The pixels of a window, counted from its corner. Integer ranges are pushed to the scan."""
    inside = F.col("row_idx").between(row_off, row_off + height - 1) & F.col("col_idx").between(col_off, col_off + width - 1)
    return pixels.filter(inside).withColumns({"row_idx": F.col("row_idx") - row_off, "col_idx": F.col("col_idx") - col_off})


def mask_values(column: str, values: list) -> Column:
    """True where the value is one of ``values``; a null is not masked."""
    return F.coalesce(F.col(column).isin(values), F.lit(False))


def apply_mask(pixels: DataFrame, bands: list[str], masked: Column, fill=0) -> DataFrame:
    """Masked pixels hold ``fill`` in every band."""
    return pixels.withColumns({b: F.when(masked, F.lit(fill)).otherwise(F.col(b)) for b in bands})


def raster_to_mask(pixels: DataFrame, band: str, values: list, inside=1, outside=0) -> DataFrame:
    """A band replaced by a mask: ``inside`` where the value is one of ``values``."""
    return pixels.withColumn(band, F.when(mask_values(band, values), F.lit(inside)).otherwise(F.lit(outside)))


def mask_by(pixels: DataFrame, mask: DataFrame, bands: list[str], fill=FILL) -> DataFrame:
    """Mask by another raster's ``masked`` column, cell by cell (grids must agree)."""
    return apply_mask(pixels.join(mask.select(*CELL, "masked"), CELL), bands, F.col("masked"), fill).drop("masked")


def pieces_of(region) -> list:
    """Pieces (outline and holes each) of a region: a ring of vertices, such pieces, or WKT or GeoJSON text.

    A text that states none is a ``ValueError``.
    """
    pieces = parse_polygon(region) if isinstance(region, str) else [[region]] if region and isinstance(region[0][0], int | float) else region
    if not pieces:
        raise ValueError("no readable region")
    return pieces


def clip(pixels: DataFrame, region, transform: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in a region (see :func:`pieces_of`); no overlap gives no rows.

    The region's box becomes a range of row and column numbers first, which the
    scan can use; the edges are tested only within it.
    """
    a, e, c, f = transform
    pieces = pieces_of(region)
    xs, ys = ([v[k] for rings in pieces for v in rings[0]] for k in (0, 1))
    rows = sorted(((min(ys) - f) / e, (max(ys) - f) / e))
    near = F.col("row_idx").between(math.floor(rows[0]), math.ceil(rows[1])) & F.col("col_idx").between(math.floor((min(xs) - c) / a), math.ceil((max(xs) - c) / a))
    x, y = centre_of(F.col("row_idx"), F.col("col_idx"), a, e, c, f)
    return pixels.filter(near).filter(in_region(x, y, pieces))


def clip_raster(pixels: DataFrame, grid, region) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """:func:`clip` of a raster with its one row of grid metadata, and the crop window.

    The rows are numbered from the corner of the window (col_off, row_off, width,
    height), which is the region's box rounded outward and cut to the grid. A
    region that the raster does not overlap is a ``ValueError``.
    """
    xs, ys = ([v[k] for rings in pieces_of(region) for v in rings[0]] for k in (0, 1))
    cols, rows = ((min(xs) - grid["c"]) / grid["a"], (max(xs) - grid["c"]) / grid["a"]), ((max(ys) - grid["f"]) / grid["e"], (min(ys) - grid["f"]) / grid["e"])
    left, right = max(math.floor(cols[0]), 0), min(math.ceil(cols[1]), grid["width"])
    top, bottom = max(math.floor(rows[0]), 0), min(math.ceil(rows[1]), grid["height"])
    if left >= right or top >= bottom:
        raise ValueError("the region does not overlap the raster")
    inside = clip(pixels, region, (grid["a"], grid["e"], grid["c"], grid["f"]))
    return window(inside, left, top, right - left, bottom - top), (left, top, right - left, bottom - top)


def clip_box(pixels: DataFrame, box: tuple[float, float, float, float], transform: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in a box (left, bottom, right, top): a range of row and column numbers."""
    a, e, c, f = transform
    left, bottom, right, top = box
    first_col, last_col = math.ceil((left - c) / a - 0.5), math.floor((right - c) / a - 0.5)
    first_row, last_row = math.ceil((top - f) / e - 0.5), math.floor((bottom - f) / e - 0.5)
    return pixels.filter(F.col("row_idx").between(first_row, last_row) & F.col("col_idx").between(first_col, last_col))


def resample_nearest(pixels: DataFrame, scale: float, height: int | None = None, width: int | None = None) -> DataFrame:
    """Nearest-neighbour resampling by ``scale`` (2 doubles the pixels per axis).

    Target pixel i takes source pixel ``floor((i + 0.5) / scale)``; turned round,
    every source pixel knows its targets, so each row expands in place: no join
    with a target grid and no shuffle.
    """
    out = pixels
    for axis, size in (("row_idx", height), ("col_idx", width)):
        first = F.ceil(F.col(axis) * scale - 0.5)
        last = F.ceil((F.col(axis) + 1) * scale - 0.5) - 1
        if size is not None:
            last = F.least(last, F.lit(int(size * scale) - 1).cast("bigint"))
        targets = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(axis, F.explode(targets))
    return out


def _cubic(x: Column) -> Column:
    return F.when(x <= 1, (1.5 * x - 2.5) * x * x + 1).otherwise(((-0.5 * x + 2.5) * x - 4) * x + 2)


def _spline(x: Column) -> Column:
    return F.when(x <= 1, (3 * x - 6) * x * x / 6 + 2 / 3).otherwise((2 - x) * (2 - x) * (2 - x) / 6)


def _lanczos(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(3 * F.sin(math.pi * x) * F.sin(math.pi * x / 3) / (math.pi * math.pi * x * x))


#: Resampling by weights: radius in pixels, and weight by distance.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {"bilinear": (1, lambda x: 1 - x), "cubic": (2, _cubic), "cubic_spline": (2, _spline), "lanczos": (3, _lanczos)}
#: Resampling by a statistic of a block of pixels; quantiles are values that occur, of equally frequent ones the smallest counts.
STATISTICS: dict[str, Callable[[str], Column]] = {
    "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "rms": lambda b: F.sqrt(F.avg(F.col(b) * F.col(b))), "mode": lambda b: F.mode(b, True),
    **{name: lambda b, q=q: F.expr(f"percentile_disc({q}) within group (order by `{b}`)") for name, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))},
}


def resample(pixels: DataFrame, bands: list[str], scale: float, method: str = "nearest", height: int | None = None, width: int | None = None) -> DataFrame:
    """Resampling by ``scale`` with any method: nearest, a kernel (needs the size), or a statistic of blocks.

    Statistics are of the whole blocks that a scale of one over an integer makes;
    another scale or method is a ``ValueError``.
    """
    if method == "nearest":
        return resample_nearest(pixels.select(*CELL, *bands), scale, height, width)
    if method in KERNELS:
        if height is None or width is None:
            raise ValueError(f"{method} needs the raster's height and width")
        return resample_kernel(pixels, bands, scale, height, width, method)
    if method not in STATISTICS:
        raise ValueError(f"unknown method {method}; known are {['nearest', *KERNELS, *STATISTICS]}")
    factor = round(1 / scale)
    if abs(factor * scale - 1) > 1e-9:
        raise ValueError(f"{method} needs a scale of one over an integer")
    return resample_statistic(pixels, bands, factor, method)


def resample_kernel(pixels: DataFrame, bands: list[str], scale: float, height: int, width: int, method: str) -> DataFrame:
    """Every target pixel weighs the source pixels around it.

    Each source pixel is sent to the targets it weighs in, and one aggregation
    sums them; weights are renewed at the border and where a neighbour is null.
    Where pixels become larger the kernel widens with them.
    """
    radius, weigh = KERNELS[method]
    wide = max(1.0, 1.0 / scale)
    out = pixels.select(*CELL, *bands)
    for axis, size, weight in (("row_idx", height, "_wr"), ("col_idx", width, "_wc")):
        at = F.col(axis)
        first = F.greatest(F.ceil((at + 0.5 - radius * wide) * scale - 0.5), F.lit(0).cast("bigint"))
        last = F.least(F.floor((at + 0.5 + radius * wide) * scale - 0.5), F.lit(int(size * scale) - 1).cast("bigint"))
        targets = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn("_t", F.explode(targets)).withColumn("_d", F.abs((F.col("_t") + 0.5) / scale - 0.5 - at) / wide).filter(F.col("_d") < radius)
        out = out.withColumn(weight, weigh(F.col("_d"))).withColumn(axis, F.col("_t")).drop("_t", "_d")
    w = F.col("_wr") * F.col("_wc")
    return out.groupBy(*CELL).agg(*[F.try_divide(F.sum(w * F.col(b)), F.sum(F.when(F.col(b).isNotNull(), w))).alias(b) for b in bands])


def resample_bilinear(pixels: DataFrame, bands: list[str], scale: float, height: int, width: int) -> DataFrame:
    """Bilinear resampling: every target pixel weighs its (up to) four neighbours."""
    return resample_kernel(pixels, bands, scale, height, width, "bilinear")


def resample_statistic(pixels: DataFrame, bands: list[str], factor: int, method: str) -> DataFrame:
    """A statistic over blocks of ``factor`` x ``factor`` pixels; nulls do not count."""
    cell = [F.floor(F.col(c) / factor).alias(c) for c in CELL]
    return pixels.groupBy(*cell).agg(*[STATISTICS[method](b).alias(b) for b in bands])


def resample_average(pixels: DataFrame, bands: list[str], factor: int) -> DataFrame:
    """Mean over blocks of ``factor`` x ``factor`` pixels; nulls do not count."""
    return resample_statistic(pixels, bands, factor, "average")


def mosaic(layers: DataFrame, nodata: float | None) -> DataFrame:
    """``(band, row_idx, col_idx, value)`` of layers laid over each other.

    ``layers`` has src_pos, band, x and y (upper left corner of the pixel), res,
    north, west, value. The last source with data wins; nodata and null are
    transparent; a cell without data is left out (:func:`fill_grid` adds zeros).
    Offsets round half to even. One aggregation with partial maxima.
    """
    row, col = F.bround((F.col("north") - F.col("y")) / F.col("res")), F.bround((F.col("x") - F.col("west")) / F.col("res"))
    placed = layers.withColumn("row_idx", row.cast("bigint")).withColumn("col_idx", col.cast("bigint")).filter(F.col("value").isNotNull())
    if nodata is not None:
        placed = placed.filter(F.col("value") != nodata)
    return placed.groupBy("band", *CELL).agg(F.max_by("value", "src_pos").alias("value"))


def mosaic_rasters(pixels: DataFrame, grids: DataFrame) -> tuple[DataFrame, dict]:
    """Rasters laid over each other on a grid of their own: ``(cells, grid)``.

    ``pixels`` is (raster_id, band, row_idx, col_idx, value), ``grids`` has
    raster_id, src_pos, a, e, c, f, width, height, nodata and band_count. The
    grid covers all rasters with the pixel size and the bands of the first, its
    size rounded up; the last raster with data wins, each raster's own nodata is
    transparent, and cells without data hold 0. An empty table of grids is a
    ``ValueError``. The extent is one aggregated row.
    """
    first = lambda c: F.min_by(c, "src_pos").alias(c)
    row = with_bounds(grids).agg(F.min("left").alias("west"), F.min("bottom").alias("south"), F.max("right").alias("east"), F.max("top").alias("north"), first("a"), first("e"), first("band_count")).first()
    if row.west is None:
        raise ValueError("no rasters to lay over each other")
    grid = {"a": row.a, "e": row.e, "c": row.west, "f": row.north, "width": math.ceil((row.east - row.west) / row.a), "height": math.ceil((row.north - row.south) / -row.e), "band_count": row.band_count}
    placed = pixels.filter(F.col("band") <= grid["band_count"]).join(grids.select("raster_id", "src_pos", "a", "e", "c", "f", "nodata"), "raster_id")
    x, y = F.col("c") + F.col("col_idx") * F.col("a"), F.col("f") + F.col("row_idx") * F.col("e")
    placed = placed.select("src_pos", "band", F.bround((F.lit(grid["f"]) - y) / -grid["e"]).cast("bigint").alias("row_idx"), F.bround((x - grid["c"]) / grid["a"]).cast("bigint").alias("col_idx"), "value", "nodata")
    seen = placed.filter("value is not null and not (value <=> nodata)")
    cells = seen.groupBy("band", *CELL).agg(F.max_by("value", "src_pos").alias("value")).filter(F.col("row_idx").between(0, grid["height"] - 1) & F.col("col_idx").between(0, grid["width"] - 1))
    return fill_grid(cells, grid["band_count"], grid["height"], grid["width"]), grid


def fill_grid(cells: DataFrame, bands: int, height: int, width: int, value: float = 0.0) -> DataFrame:
    """Every cell of the grid, with ``value`` where ``cells`` has none."""
    spark = cells.sparkSession
    dense = spark.range(bands * height * width).select((F.floor(F.col("id") / (height * width)) + 1).cast("int").alias("band"), F.floor(F.col("id") % (height * width) / width).alias("row_idx"), (F.col("id") % width).alias("col_idx"))
    return dense.join(cells, ["band", *CELL], "left").withColumn("value", F.coalesce("value", F.lit(value)))


def stack(pixels_long: DataFrame, bands: list[int]) -> DataFrame:
    """Wide pixels b<n> of long ones; one shuffle however many bands there are."""
    columns = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands]
    return pixels_long.groupBy(*CELL).agg(*columns)


def unstack(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Long pixels (band from 1) of wide ones, without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(b).alias("value")) for i, b in enumerate(bands)])
    return pixels.select(*CELL, F.explode(pairs).alias("p")).select(*CELL, "p.band", "p.value")


def compatible(grids: DataFrame) -> DataFrame:
    """One row: do all grids agree in reference system, size and resolution?

    The reference system is compared in one spelling; missing ones count as one of their own.
    """
    crs = F.coalesce(F.upper(F.regexp_replace("crs", r"\s+", "")), F.lit(""))
    same = lambda *c: (F.count_distinct(*c) <= 1)
    return grids.agg(same(crs).alias("same_crs"), same("width", "height").alias("same_size"), same("a", "e").alias("same_resolution"))


def block_statistics(pixels: DataFrame, band: str, block: int) -> DataFrame:
    """Count, sum and range of a band per block; combined before the shuffle."""
    keys = [F.floor(F.col("row_idx") / block).alias("tile_row"), F.floor(F.col("col_idx") / block).alias("tile_col")]
    return pixels.groupBy(*keys).agg(F.count(band).alias("n"), F.sum(band).alias("total"), F.min(band).alias("low"), F.max(band).alias("high"))


def add_indexes(pixels: DataFrame, indexes: dict[str, tuple[str, list[str]]], scale: int = 1000) -> DataFrame:
    """Index columns ``name -> (index, bands)``, in order; one may use an earlier one.

    An unknown band or index is a ``ValueError``.
    """
    for name, (index, bands) in indexes.items():
        missing = [b for b in bands if b not in pixels.columns]
        if missing:
            raise ValueError(f"unknown bands {missing}")
        pixels = pixels.withColumn(name, index_column(index, [F.col(b) for b in bands], scale))
    return pixels
