"""Queries on single rasters: scans, windows, masks, indexes, resampling, mosaics, stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite_or_zero, index_column, wrap_cast
from gridloom.operators import grid as g
from gridloom.operators import raster as r
from gridloom.operators.display import histogram, recode, stretch_8bit
from gridloom.plans.fixtures import BANDS, FOOT, PAIRS, PX, UNIT, bands, footprints, pairs, px
from gridloom.plans.registry import Registry
from gridloom.session import table
from gridloom.sources.tiles import from_tiles, to_tiles

reg = Registry()
query = reg.query

NODATA = 100
#: Window (col_off, row_off, width, height) of the read queries.
AREA = (10, 2, 60, 12)
BOX = (20.25, -14.75, 71.5, -3.2)
RING = [(5.0, -1.0), (60.0, -3.5), (88.0, -11.0), (40.0, -8.0), (10.0, -14.5)]
_ALL = ", ".join(BANDS)


def _sql_index(num: str, den: str, scaled: bool = True) -> str:
    q = f"coalesce(CAST(({num}) AS FLOAT) / nullif(CAST(({den}) AS FLOAT), 0), CAST(0 AS FLOAT))"
    return f"CAST(trunc({q} * CAST(1000 AS FLOAT)) AS BIGINT)" if scaled else q


@query(f"WITH {PX} SELECT row_idx, col_idx, {_ALL}, scl FROM px")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return bands(spark, d, *BANDS, "scl")


@query(f"WITH {PX} SELECT row_idx, col_idx, " + ", ".join(f"nullif({b}, {NODATA}) AS {b}" for b in BANDS) + " FROM px")
def scan_masked_nodata(spark: SparkSession, d: str) -> DataFrame:
    return r.masked_read(bands(spark, d, *BANDS), BANDS, NODATA)


@query(f"WITH {PX} SELECT row_idx, col_idx, nir, red FROM px")
def select_bands(spark: SparkSession, d: str) -> DataFrame:
    return r.select_bands(px(spark, d), BANDS, [4, 1])


@query(f"WITH {PX} SELECT row_idx - 2 AS row_idx, col_idx - 10 AS col_idx, red, nir FROM px WHERE row_idx BETWEEN 2 AND 13 AND col_idx BETWEEN 10 AND 69")
def window_read(spark: SparkSession, d: str) -> DataFrame:
    return r.window(bands(spark, d, "red", "nir"), *AREA)


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """Grid metadata of the derived raster."""
    return px(spark, d).agg((F.max("row_idx") + 1).cast("int").alias("height")).select(F.lit("px").alias("raster_id"), F.lit(1.0).alias("a"), F.lit(-1.0).alias("e"), F.lit(0.0).alias("c"), F.lit(0.0).alias("f"), F.lit(100).alias("width"), "height")


@query(f"""WITH {PX}, s AS (SELECT CAST(max(row_idx) + 1 AS INTEGER) AS h FROM px)
SELECT 'px' AS raster_id, CAST(tr AS INTEGER) AS tile_row, CAST(tc AS INTEGER) AS tile_col, CAST(tr * 32 AS INTEGER) AS row_off, CAST(tc * 32 AS INTEGER) AS col_off,
  CAST(least(32, h - tr * 32) AS INTEGER) AS height, CAST(least(32, 100 - tc * 32) AS INTEGER) AS width
FROM s, range(100000) a(tr), range(4) b(tc) WHERE tr <= (h - 1) // 32""")  # fmt: skip
def block_windows(spark: SparkSession, d: str) -> DataFrame:
    return g.block_windows(_grids(spark, d), 32)


@query(f"WITH {PX} SELECT row_idx // 32 AS tile_row, col_idx // 32 AS tile_col, count(red) AS n, CAST(sum(red) AS BIGINT) AS total, min(red) AS low, max(red) AS high FROM px GROUP BY 1, 2")
def block_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return r.block_statistics(px(spark, d), "red", 32)


@query(f"WITH {PX}, u AS (SELECT row_idx, col_idx, unnest([1, 2, 3, 4, 5]) AS band, unnest([{_ALL}]) AS value FROM px) SELECT CAST(band AS INTEGER) AS band, row_idx, col_idx, value FROM u")
def tile_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Long pixels gathered into tiles of 25 x 25 and taken apart again."""
    long = r.unstack(bands(spark, d, *BANDS), BANDS)
    return from_tiles(to_tiles(long, 25), 25).select("band", "row_idx", "col_idx", "value")


@query(f"WITH {PAIRS} SELECT CAST(band AS INTEGER) AS band, row_idx, col_idx, x, y FROM pairs")
def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Equally numbered bands of two rasters, cell by cell."""
    both = pairs(spark, d)
    first, second = both.select("band", "row_idx", "col_idx", "x"), both.select("band", "row_idx", "col_idx", "y")
    return first.join(second, ["band", "row_idx", "col_idx"])


@query(f"WITH {PX} SELECT row_idx - 2 AS row_idx, col_idx - 10 AS col_idx, nir AS b1, swir AS b2 FROM px WHERE row_idx BETWEEN 2 AND 13 AND col_idx BETWEEN 10 AND 69")
def stack_window(spark: SparkSession, d: str) -> DataFrame:
    long = r.unstack(r.window(bands(spark, d, "nir", "swir"), *AREA), ["nir", "swir"])
    return r.stack(long, [1, 2])


@query(f"WITH {PX} SELECT row_idx, col_idx, scl, scl IN (3, 7, 8, 9, 10) AS masked FROM px")
def mask_vals(spark: SparkSession, d: str) -> DataFrame:
    return bands(spark, d, "scl").withColumn("masked", r.mask_values("scl", r.CLOUD_CLASSES))


@query(f"WITH {PX} SELECT row_idx, col_idx, {_sql_index('nir - red', 'nir + red', False)} > 0.3 AS masked FROM px")
def mask_cond(spark: SparkSession, d: str) -> DataFrame:
    return bands(spark, d, "red", "nir").select("row_idx", "col_idx", (index_column("ndvi", [F.col("red"), F.col("nir")], 1).cast("double") > 0.3).alias("masked"))


@query(f"WITH {PX} SELECT row_idx, col_idx, CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 0 ELSE red END AS red, CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 0 ELSE nir END AS nir FROM px")
def apply_mask_fill(spark: SparkSession, d: str) -> DataFrame:
    return r.apply_mask(bands(spark, d, "red", "nir", "scl"), ["red", "nir"], r.mask_values("scl", r.CLOUD_CLASSES)).drop("scl")


@query(f"WITH {PX} SELECT row_idx, col_idx, " + ", ".join(f"CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 9999 ELSE {b} END AS {b}" for b in BANDS) + " FROM px")
def cloud_mask_join(spark: SparkSession, d: str) -> DataFrame:
    """Bands masked by another raster, the scene classification."""
    mask = bands(spark, d, "scl").select("row_idx", "col_idx", r.mask_values("scl", r.CLOUD_CLASSES).alias("masked"))
    return r.mask_by(bands(spark, d, *BANDS), mask, BANDS)


def _index(name: str, used: list[str], scale: int = 1000):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return bands(spark, d, *used).select("row_idx", "col_idx", index_column(name, [F.col(b) for b in used], scale).alias(name))

    return run


_MASKED = "CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 9999 ELSE {0} END"


@query(f"WITH {PX}, m AS (SELECT row_idx, col_idx, {_MASKED.format('red')} AS red, {_MASKED.format('nir')} AS nir FROM px) SELECT row_idx, col_idx, {_sql_index('nir - red', 'nir + red')} AS ndvi FROM m")
def ndvi_int(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: cloud mask with fill 9999, then the scaled index, in one projection."""
    masked = r.apply_mask(bands(spark, d, "red", "nir", "scl"), ["red", "nir"], r.mask_values("scl", r.CLOUD_CLASSES), r.FILL)
    return masked.select("row_idx", "col_idx", index_column("ndvi", [F.col("red"), F.col("nir")]).alias("ndvi"))


query(f"WITH {PX} SELECT row_idx, col_idx, {_sql_index('nir - red', 'nir + red', False)} AS ndvi FROM px", "ndvi_float")(_index("ndvi", ["red", "nir"], 1))
query(f"WITH {PX} SELECT row_idx, col_idx, {_sql_index('nir - swir', 'nir + swir')} AS nbr FROM px", "nbr_int")(_index("nbr", ["nir", "swir"]))
query(f"WITH {PX} SELECT row_idx, col_idx, {_sql_index('green - nir', 'green + nir')} AS ndwi FROM px", "ndwi_int")(_index("ndwi", ["green", "nir"]))
query(f"WITH {PX} SELECT row_idx, col_idx, {_sql_index('(swir + red) - (nir + blue)', '(swir + red) + (nir + blue)')} AS bsi FROM px", "bsi_int")(_index("bsi", ["blue", "red", "nir", "swir"]))


@query(f"WITH {PX}, n AS (SELECT *, {_sql_index('nir - red', 'nir + red')} AS ndvi FROM px) SELECT row_idx, col_idx, ndvi, {_sql_index('ndvi - swir', 'ndvi + swir')} AS chained FROM n")
def index_chain(spark: SparkSession, d: str) -> DataFrame:
    """An index over an earlier index."""
    out = r.add_indexes(bands(spark, d, "red", "nir", "swir"), {"ndvi": ("ndvi", ["red", "nir"]), "chained": ("nbr", ["ndvi", "swir"])})
    return out.select("row_idx", "col_idx", "ndvi", "chained")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 0.0 ELSE value END AS value FROM events")
def nan_to_num(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    broken = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, float("-inf")).otherwise(F.col("value"))
    return e.select("event_id", finite_or_zero(broken).alias("value"))


@query(f"""WITH {PX}, n AS (SELECT row_idx, col_idx, {_sql_index('nir - red', 'nir + red')} AS v FROM px)
SELECT row_idx, col_idx, (v % 65536 + 65536) % 65536 AS u16, (v % 256 + 256) % 256 AS u8 FROM n""")
def uint16_wrap_cast(spark: SparkSession, d: str) -> DataFrame:
    """Negative indexes stored in unsigned pixels wrap around."""
    v = index_column("ndvi", [F.col("red"), F.col("nir")])
    return bands(spark, d, "red", "nir").select("row_idx", "col_idx", wrap_cast(v, "uint16").alias("u16"), wrap_cast(v, "uint8").alias("u8"))


@query(f"WITH {PX} SELECT row_idx * 2 + i AS row_idx, col_idx * 2 + j AS col_idx, red FROM px, range(2) a(i), range(2) b(j)")
def resample_up2(spark: SparkSession, d: str) -> DataFrame:
    return r.resample_nearest(bands(spark, d, "red"), 2)


@query(f"WITH {PX} SELECT row_idx // 2 AS row_idx, col_idx // 2 AS col_idx, nir FROM px WHERE row_idx % 2 = 1 AND col_idx % 2 = 1")
def resample_down2(spark: SparkSession, d: str) -> DataFrame:
    return r.resample_nearest(bands(spark, d, "nir"), 0.5)


@query(f"""WITH {PX}, s AS (SELECT max(row_idx) + 1 AS h FROM px), t AS (SELECT i AS row_idx, j AS col_idx, (i + 0.5) / 2 - 0.5 AS r, (j + 0.5) / 2 - 0.5 AS c FROM s, range(100000) a(i), range(200) b(j) WHERE i < h * 2),
k AS (SELECT t.row_idx, t.col_idx, (1 - abs(r - px.row_idx)) * (1 - abs(c - px.col_idx)) AS w, red FROM t, range(2) a(di), range(2) b(dj) JOIN px ON px.row_idx = CAST(floor(r) AS BIGINT) + di AND px.col_idx = CAST(floor(c) AS BIGINT) + dj)
SELECT row_idx, col_idx, round(CAST(sum(w * red) / sum(w) AS DOUBLE), 6) AS red FROM k WHERE w > 0 GROUP BY 1, 2""")
def resample_bilinear2(spark: SparkSession, d: str) -> DataFrame:
    height = (px(spark, d).agg(F.max("row_idx")).first()[0] or 0) + 1
    return r.resample_bilinear(bands(spark, d, "red"), ["red"], 2, int(height), 100).select("row_idx", "col_idx", F.round("red", 6).alias("red"))


@query(f"WITH {PX} SELECT row_idx, col_idx, CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 1 ELSE 0 END AS scl FROM px")
def raster_to_mask(spark: SparkSession, d: str) -> DataFrame:
    return r.raster_to_mask(bands(spark, d, "scl"), "scl", r.CLOUD_CLASSES)


@query("""WITH b AS (SELECT raster_id, c, f, a, e, width, height, greatest(CAST(floor((912345.0 - c) / a) AS INTEGER), 0) AS col_off, greatest(CAST(floor((9890000.0 - f) / e) AS INTEGER), 0) AS row_off,
  least(CAST(ceil((925000.5 - c) / a) AS INTEGER), width) AS r, least(CAST(ceil((9871000.0 - f) / e) AS INTEGER), height) AS t FROM rasters)
SELECT raster_id, col_off, row_off, c + a * col_off AS c, f + e * row_off AS f, r - col_off AS width, t - row_off AS height FROM b WHERE r > col_off AND t > row_off""")
def polygon_crop_window(spark: SparkSession, d: str) -> DataFrame:
    """The window that a polygon cuts out of every raster it meets."""
    ring = [(912345.0, 9890000.0), (925000.5, 9880000.0), (920000.0, 9871000.0)]
    return g.crop_window(table(spark, d, "rasters"), ring).select("raster_id", "col_off", "row_off", "c", "f", "width", "height")


@query(f"WITH {PX} SELECT row_idx // 4 AS row_idx, col_idx // 4 AS col_idx, avg(red) AS red FROM px GROUP BY 1, 2")
def resample_average4(spark: SparkSession, d: str) -> DataFrame:
    return r.resample_average(bands(spark, d, "red"), ["red"], 4)


@query(f"""WITH {PX}, l AS (SELECT o_orderkey % 3 AS src, row_idx + (o_orderkey % 3) * 5 AS row_idx, col_idx + (o_orderkey % 3) * 7 AS col_idx, red % 50 AS value FROM px),
w AS (SELECT row_idx, col_idx, arg_max(value, src) AS value FROM l WHERE value <> 0 GROUP BY 1, 2),
grid AS (SELECT y AS row_idx, x AS col_idx FROM (SELECT max(row_idx) + 11 AS h FROM px) s, range(200000) a(y), range(114) b(x) WHERE y < h)
SELECT CAST(1 AS INTEGER) AS band, row_idx, col_idx, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM grid LEFT JOIN w USING (row_idx, col_idx)""")  # fmt: skip
def mosaic_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Three shifted layers of one raster laid over each other; 0 is transparent."""
    p = px(spark, d).withColumn("src", F.col("o_orderkey") % 3)
    layers = p.select(
        F.col("src").cast("int").alias("src_pos"), F.lit(1).alias("band"), (F.col("col_idx") + F.col("src") * 7).cast("double").alias("x"),
        (-(F.col("row_idx") + F.col("src") * 5)).cast("double").alias("y"), F.lit(1.0).alias("res"), F.lit(0.0).alias("north"), F.lit(0.0).alias("west"), (F.col("red") % 50).cast("double").alias("value"),
    )
    height = (px(spark, d).agg(F.max("row_idx")).first()[0] or 0) + 11
    return r.fill_grid(r.mosaic(layers, 0.0), 1, int(height), 114)


@query(f"WITH {PX} SELECT row_idx, col_idx, " + ", ".join(f"{b} AS b{i + 1}" for i, b in enumerate(BANDS)) + " FROM px")
def stack_bands(spark: SparkSession, d: str) -> DataFrame:
    return r.stack(r.unstack(bands(spark, d, *BANDS), BANDS), [1, 2, 3, 4, 5])


@query(f"WITH {PX} SELECT row_idx, col_idx, swir, red, swir AS swir_2 FROM px")
def stack_reorder(spark: SparkSession, d: str) -> DataFrame:
    """A new band order that drops some bands and repeats one."""
    return r.select_bands(bands(spark, d, *BANDS), BANDS, [5, 1, 5])


@query("""SELECT count(DISTINCT coalesce(upper(regexp_replace(crs, '\\s+', '', 'g')), '')) <= 1 AS same_crs, count(DISTINCT (width, height)) <= 1 AS same_size, count(DISTINCT (a, e)) <= 1 AS same_resolution FROM rasters""")
def stack_compat_check(spark: SparkSession, d: str) -> DataFrame:
    return r.compatible(table(spark, d, "rasters").select("crs", "width", "height", "a", "e"))


@query("""SELECT min(c) AS "left", min(f + e * height) AS bottom, max(c + a * width) AS "right", max(f) AS top FROM rasters""")
def union_extent(spark: SparkSession, d: str) -> DataFrame:
    return g.union_extent(table(spark, d, "rasters").select("raster_id", "a", "e", "c", "f", "width", "height"))


@query(f"""WITH {FOOT} SELECT * FROM foot""")
def footprints_boxes(spark: SparkSession, d: str) -> DataFrame:
    return footprints(spark, d)


@query("""SELECT raster_id, c AS "left", f + e * height AS bottom, c + a * width AS "right", f AS top FROM rasters""", "footprints")
def raster_footprints(spark: SparkSession, d: str) -> DataFrame:
    return g.with_bounds(table(spark, d, "rasters")).select("raster_id", "left", "bottom", "right", "top")


@query("SELECT raster_id, c + a * 10 AS c, f + e * 2 AS f, 60 AS width, 12 AS height FROM rasters")
def window_metadata(spark: SparkSession, d: str) -> DataFrame:
    return g.window_grid(table(spark, d, "rasters"), *AREA).select("raster_id", "c", "f", "width", "height")


@query(f"WITH {PX} SELECT row_idx, col_idx, red FROM px WHERE col_idx + 0.5 BETWEEN {BOX[0]} AND {BOX[2]} AND -(row_idx + 0.5) BETWEEN {BOX[1]} AND {BOX[3]}")
def polygon_clip_box(spark: SparkSession, d: str) -> DataFrame:
    return r.clip_box(bands(spark, d, "red"), BOX, UNIT)


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1]))


@query(f"""WITH {PX}, e(x1, y1, x2, y2) AS (VALUES {_EDGES}), k AS (SELECT row_idx, col_idx FROM px, e
WHERE (y1 > -(row_idx + 0.5)) <> (y2 > -(row_idx + 0.5)) AND col_idx + 0.5 < (x2 - x1) * (-(row_idx + 0.5) - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT row_idx, col_idx, red FROM px JOIN k USING (row_idx, col_idx)""")
def polygon_clip_ring(spark: SparkSession, d: str) -> DataFrame:
    return r.clip(bands(spark, d, "red"), RING, UNIT)


@query(f"WITH {PX}, s AS (SELECT min(nir) AS lo, max(nir) AS hi FROM px) SELECT CAST(least(floor((nir - lo) / CAST(hi - lo AS DOUBLE) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM px, s GROUP BY 1")
def histogram50(spark: SparkSession, d: str) -> DataFrame:
    return histogram(bands(spark, d, "nir"), "nir")


@query(f"WITH {PX}, s AS (SELECT greatest(max(red), max(green), max(blue)) AS t FROM px) SELECT row_idx, col_idx, " + ", ".join(f"CAST(trunc(255 * (CAST({b} AS DOUBLE) / CAST(t AS DOUBLE))) AS INTEGER) AS {b}" for b in ("red", "green", "blue")) + " FROM px, s", "stretch_8bit")
def stretch_rgb(spark: SparkSession, d: str) -> DataFrame:
    return stretch_8bit(bands(spark, d, "red", "green", "blue"), ["red", "green", "blue"])


@query(f"WITH {PX} SELECT row_idx, col_idx, CAST(CASE scl WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 4 WHEN 9 THEN 0 ELSE scl END AS BIGINT) AS cls FROM px")
def recode_classes(spark: SparkSession, d: str) -> DataFrame:
    """Chained replacement: 1 becomes 2, and 2 (old or new) becomes 7."""
    return bands(spark, d, "scl").select("row_idx", "col_idx", recode(F.col("scl"), [(1, 2), (2, 7), (3, 4), (9, 0)]).cast("bigint").alias("cls"))


def queries() -> dict:
    return reg.queries


def oracle_sql() -> dict:
    return reg.sql
