"""Queries that go through files and whole workflows: rasters, scenes, vectors, documents and reports written and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import output_name
from gridloom.operators import classify as cl
from gridloom.operators import display as dp
from gridloom.operators import overlap as ov
from gridloom.operators import raster as r
from gridloom.operators import sampling as sp
from gridloom.plans import workflow as wf
from gridloom.plans.analysis import _assets
from gridloom.plans.fixtures import BANDS, FOOT, POINTS, PRED, PX, UNIT, bands, cloud_flags, footprints, points, predictions, px, samples
from gridloom.plans.registry import Registry
from gridloom.session import cut, scratch, table
from gridloom.sources import catalog as ct
from gridloom.sources import documents as doc
from gridloom.sources import geotiff as gt
from gridloom.sources import vector as vc

reg = Registry()
query = reg.query

GRID = "raster_id string, width int, height int, a double, e double, c double, f double, crs string, nodata double"


def _height(spark: SparkSession, d: str) -> int:
    return int((px(spark, d).agg(F.max("row_idx")).first()[0] or 0) + 1)


# --- rasters ----------------------------------------------------------------------


@query(f"WITH {PX}, u AS (SELECT row_idx, col_idx, unnest([1, 2, 3]) AS band, unnest([red, nir, swir]) AS value FROM px) SELECT CAST(band AS INTEGER) AS band, row_idx, col_idx, CAST(value AS DOUBLE) AS value FROM u")
def geotiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pixels written as a tiled raster of three bands and read again."""
    grid = spark.createDataFrame([("scene", 100, _height(spark, d), 10.0, -10.0, 500_000.0, 9_900_000.0, "EPSG:32737", None)], GRID)
    with scratch(spark, "rasters") as folder:
        gt.write_rasters(r.unstack(bands(spark, d, "red", "nir", "swir"), ["red", "nir", "swir"]).withColumn("raster_id", F.lit("scene")), grid, folder, "uint16", 64)
        return cut(gt.pixels_of(gt.read_rasters(spark, folder)).select("band", "row_idx", "col_idx", "value"), "read")


@query(f"""WITH {PX}, s AS (SELECT CAST(max(row_idx) + 1 AS INTEGER) AS h FROM px) SELECT 'scene' AS raster_id, 'EPSG:32737' AS crs, 100 AS width, h AS height, 5 AS band_count, 'uint16' AS dtype, 10.0::DOUBLE AS a, -10.0::DOUBLE AS e, 500000.0::DOUBLE AS c, 9900000.0::DOUBLE AS f, 7.0::DOUBLE AS nodata FROM s""")
def geotiff_metadata(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([("scene", 100, _height(spark, d), 10.0, -10.0, 500_000.0, 9_900_000.0, "EPSG:32737", 7.0)], GRID)
    with scratch(spark, "rasters") as folder:
        gt.write_rasters(r.unstack(bands(spark, d, *BANDS), BANDS).withColumn("raster_id", F.lit("scene")), grid, folder)
        return cut(gt.read_grids(spark, folder).select("raster_id", "crs", "width", "height", "band_count", "dtype", "a", "e", "c", "f", "nodata"), "read")


@query(f"WITH {PX} SELECT row_idx, col_idx, CAST(scl AS DOUBLE) AS value FROM px WHERE row_idx BETWEEN 3 AND 12 AND col_idx BETWEEN 20 AND 69")
def class_map_raster(spark: SparkSession, d: str) -> DataFrame:
    """Classes as a raster of unsigned bytes, of which a window is read."""
    grid = spark.createDataFrame([("map", 100, _height(spark, d), 1.0, -1.0, 0.0, 0.0, None, None)], GRID)
    with scratch(spark, "maps") as folder:
        gt.write_class_map(bands(spark, d, "scl").withColumn("raster_id", F.lit("map")), grid, folder, "scl", 32)
        read = gt.pixels_of(gt.read_rasters(spark, folder, window="20,3,50,10"))
        return cut(read.filter("row_idx between 3 and 12 and col_idx between 20 and 69").select("row_idx", "col_idx", "value"), "read")


@query(f"""WITH {PX}, l AS (SELECT o_orderkey % 3 AS src, row_idx + (o_orderkey % 3) * 5 AS row_idx, col_idx + (o_orderkey % 3) * 7 AS col_idx, red % 50 AS value FROM px),
w AS (SELECT row_idx, col_idx, arg_max(value, src) AS value FROM l WHERE value <> src GROUP BY 1, 2),
grid AS (SELECT y AS row_idx, x AS col_idx FROM (SELECT max(row_idx) + 11 AS h FROM px) s, range(200000) a(y), range(114) b(x) WHERE y < h)
SELECT CAST(1 AS INTEGER) AS band, row_idx, col_idx, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM grid LEFT JOIN w USING (row_idx, col_idx)""")  # fmt: skip
def mosaic_from_grids(spark: SparkSession, d: str) -> DataFrame:
    """A mosaic whose extent, size and pixels follow from its sources; each source has a nodata value of its own."""
    pixels, grids = _layers(spark, d)
    return r.mosaic_rasters(pixels, grids.withColumns({"nodata": F.col("src_pos").cast("double"), "band_count": F.lit(1)}))[0]


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three rasters of one size, shifted against each other; a cell is in one of them."""
    k = F.col("o_orderkey") % 3
    pixels = px(spark, d).select(F.concat(F.lit("T0"), k.cast("string"), F.lit("MBN_20170718")).alias("raster_id"), F.lit(1).alias("band"), "row_idx", "col_idx", (F.col("red") % 50).cast("double").alias("value"))
    rows = [(f"T0{i}MBN_20170718", i, 100, _height(spark, d), 1.0, -1.0, 7.0 * i, -5.0 * i) for i in range(3)]
    return pixels, spark.createDataFrame(rows, "raster_id string, src_pos int, width int, height int, a double, e double, c double, f double")


_CUBIC = "CASE WHEN {0} <= 1 THEN (1.5 * {0} - 2.5) * {0} * {0} + 1 ELSE ((-0.5 * {0} + 2.5) * {0} - 4) * {0} + 2 END"


@query(f"""WITH {PX}, s AS (SELECT max(row_idx) + 1 AS h FROM px), t AS (SELECT i AS row_idx, j AS col_idx, (i + 0.5) / 2 - 0.5 AS r, (j + 0.5) / 2 - 0.5 AS c FROM s, range(100000) a(i), range(200) b(j) WHERE i < h * 2),
k AS (SELECT t.row_idx, t.col_idx, abs(r - px.row_idx) AS dr, abs(c - px.col_idx) AS dc, red FROM t, range(-1, 3) a(di), range(-1, 3) b(dj) JOIN px ON px.row_idx = CAST(floor(r) AS BIGINT) + di AND px.col_idx = CAST(floor(c) AS BIGINT) + dj),
w AS (SELECT row_idx, col_idx, ({_CUBIC.format('dr')}) * ({_CUBIC.format('dc')}) AS w, red FROM k WHERE dr < 2 AND dc < 2) SELECT row_idx, col_idx, round(CAST(sum(w * red) / sum(w) AS DOUBLE), 5) AS red FROM w GROUP BY 1, 2""")
def resample_cubic2(spark: SparkSession, d: str) -> DataFrame:
    return r.resample(bands(spark, d, "red"), ["red"], 2, "cubic", _height(spark, d), 100).select("row_idx", "col_idx", F.round("red", 5).alias("red"))


@query(f"""WITH {PX}, g AS (SELECT row_idx // 4 AS row_idx, col_idx // 4 AS col_idx, red, scl FROM px), m AS (SELECT row_idx, col_idx, scl, count(*) AS n FROM g GROUP BY 1, 2, 3),
mode AS (SELECT row_idx, col_idx, first(scl ORDER BY n DESC, scl) AS scl FROM m GROUP BY 1, 2)
SELECT row_idx, col_idx, mode.scl, quantile_disc(red, 0.5) AS med, quantile_disc(red, 0.75) AS q3, min(red) AS low, max(red) AS high, round(sqrt(avg(CAST(red AS DOUBLE) * red)), 6) AS rms FROM g JOIN mode USING (row_idx, col_idx) GROUP BY 1, 2, 3""")
def resample_statistics4(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 4 x 4 by mode, quantiles, range and root mean square."""
    one = lambda band, method, name: r.resample(bands(spark, d, band), [band], 0.25, method).withColumnRenamed(band, name)
    parts = [one("scl", "mode", "scl"), *(one("red", m, n) for m, n in (("med", "med"), ("q3", "q3"), ("min", "low"), ("max", "high"), ("rms", "rms")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, ["row_idx", "col_idx"])
    return out.withColumn("rms", F.round("rms", 6))


#: Two pieces, one with a hole.
REGION = "MULTIPOLYGON (((5.25 -1.1, 60.6 -3.55, 88.1 -11.2, 40.4 -9.8, 10.3 -14.5, 5.25 -1.1), (20.2 -4.4, 35.3 -5.2, 30.1 -8.3, 20.2 -4.4)), ((70.2 -1.3, 95.4 -2.2, 80.8 -6.6, 70.2 -1.3)))"
_RINGS = [(1, [(5.25, -1.1), (60.6, -3.55), (88.1, -11.2), (40.4, -9.8), (10.3, -14.5)]), (1, [(20.2, -4.4), (35.3, -5.2), (30.1, -8.3)]), (2, [(70.2, -1.3), (95.4, -2.2), (80.8, -6.6)])]
_EDGES = ", ".join(f"({piece}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for piece, ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1]))
_INSIDE = f"""e(piece, x1, y1, x2, y2) AS (VALUES {_EDGES}), k AS (SELECT row_idx, col_idx, piece FROM px, e
WHERE (y1 > -(row_idx + 0.5)) <> (y2 > -(row_idx + 0.5)) AND col_idx + 0.5 < (x2 - x1) * (-(row_idx + 0.5) - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query(f"WITH {PX}, {_INSIDE} SELECT DISTINCT row_idx, col_idx, red FROM px JOIN k USING (row_idx, col_idx)")
def polygon_clip_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in a region of several pieces with a hole."""
    return r.clip(bands(spark, d, "red"), REGION, UNIT)


@query(f"WITH {PX}, {_INSIDE} SELECT row_idx - 1 AS row_idx, col_idx - 5 AS col_idx, red FROM px JOIN (SELECT DISTINCT row_idx, col_idx FROM k) USING (row_idx, col_idx)")
def polygon_crop(spark: SparkSession, d: str) -> DataFrame:
    """The same, counted from the corner of the crop window; no overlap would be an error."""
    grid = {"a": 1.0, "e": -1.0, "c": 0.0, "f": 0.0, "width": 100, "height": _height(spark, d)}
    return r.clip_raster(bands(spark, d, "red"), grid, REGION)[0]


@query(f"WITH {PX}, {_INSIDE} SELECT CAST(piece AS BIGINT) AS region, row_idx, col_idx, red FROM px JOIN k USING (row_idx, col_idx)")
def regions_clip(spark: SparkSession, d: str) -> DataFrame:
    """A raster and several regions of any shape, by triangles."""
    first, second = REGION.removeprefix("MULTIPOLYGON (").removesuffix(")").replace(")), ((", "))|((").split("|")
    regions = spark.createDataFrame([(1, f"POLYGON {first}"), (2, f"POLYGON {second}")], "region long, geometry string")
    return ov.cells_in_regions(bands(spark, d, "red"), regions, "region", "geometry", UNIT).select("region", "row_idx", "col_idx", "red")


@query(f"WITH {PX}, s AS (SELECT greatest(max(red), max(green), max(blue)) AS t FROM px) SELECT row_idx, col_idx, " + ", ".join(f"CAST(trunc(255 * (CAST(nullif({b}, 100) AS DOUBLE) / CAST(t AS DOUBLE))) AS INTEGER) AS {b}" for b in ("red", "green", "blue")) + " FROM px, s")
def image_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Three bands in display order, without nodata, stretched together."""
    return dp.image(bands(spark, d, "blue", "green", "red"), ["blue", "green", "red"], [3, 2, 1], 100).select("row_idx", "col_idx", "red", "green", "blue")


#: Label, plot index and colour of the classes of a plot.
_PLOT = {"water": 1, "soil": 2, "trees": 5, "town": 7}
_COLOURS = {"water": (0, (0, 0, 255)), "soil": (3, (255, 204, 51)), "trees": (1, (0, 102, 0)), "town": (2, (255, 0, 0))}


@query(f"""WITH {PX}, a AS (SELECT row_idx, col_idx, CASE WHEN scl = 1 THEN 0 WHEN scl = 2 THEN 3 WHEN scl = 5 THEN 1 WHEN scl = 7 THEN 2 ELSE scl END AS i FROM px)
SELECT row_idx, col_idx, CAST(i AS INTEGER) AS "index", CAST(CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS red, CAST(CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 ELSE 1.0 END AS DOUBLE) AS green, CAST(CASE i WHEN 1 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS blue FROM a""")
def class_plot(spark: SparkSession, d: str) -> DataFrame:
    """Plot indexes and colours of a class map; two of four classes are shown, all else is white."""
    made = dp.class_plot(bands(spark, d, "scl"), "scl", _PLOT, _COLOURS, ["water", "trees"])
    return made.select("row_idx", "col_idx", "index", *[F.element_at("colour", k + 1).alias(c) for k, c in enumerate(("red", "green", "blue"))])


@query("SELECT * FROM (VALUES (0, 'water', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 'trees', 0.0, 0.4, 0.0), (2, 'town', 1.0, 1.0, 1.0), (3, 'soil', 1.0, 1.0, 1.0)) t(\"index\", classname, red, green, blue)")
def legend(spark: SparkSession, d: str) -> DataFrame:
    """The legend of that plot in the order of its indexes."""
    rows = [(index, name, *rgb) for name, index, *rgb in dp.class_colours(_COLOURS, ["water", "trees"])]
    return spark.createDataFrame(rows, "index int, classname string, red double, green double, blue double")


@query("""SELECT raster_id, c AS "left", c + a * width AS "right", f + e * height AS bottom, f AS top FROM rasters""")
def plot_extent(spark: SparkSession, d: str) -> DataFrame:
    return dp.plot_extent(table(spark, d, "rasters"))


# --- overlaps ---------------------------------------------------------------------

_LAYER = """lay AS (SELECT o_orderkey % 3 AS k, row_idx, col_idx, red % 50 AS value, 7 * (o_orderkey % 3) + col_idx + 0.5 AS x, -5 * (o_orderkey % 3) - row_idx - 0.5 AS y FROM px), sz AS (SELECT max(row_idx) + 1 AS h FROM px),
foot3 AS (SELECT i AS k, 7.0 * i AS l, -5.0 * i - h AS b, 7.0 * i + 100 AS r, -5.0 * i AS t, h FROM range(3) a(i), sz)"""


@query(f"""WITH {PX}, {_LAYER}, p AS (SELECT a.k AS i, b.k AS j, greatest(a.l, b.l) AS l, greatest(a.b, b.b) AS b, least(a.r, b.r) AS r, least(a.t, b.t) AS t FROM foot3 a JOIN foot3 b ON a.k < b.k AND a.b <= b.t AND b.b <= a.t),
n AS (SELECT row_number() OVER (ORDER BY i, j) AS poly, l, b, r, t FROM p WHERE t > b),
z AS (SELECT foot3.k, poly, n.l, n.b, n.r, n.t, CAST(greatest(foot3.t - n.t, 0) AS BIGINT) AS r0, CAST(greatest(n.l - foot3.l, 0) AS BIGINT) AS c0, CAST(least(foot3.t - n.b, h) AS BIGINT) AS r1, CAST(least(n.r - foot3.l, 100) AS BIGINT) AS c1 FROM foot3, n)
SELECT concat('T0', k, 'MBN_20170718_poly_', poly, '_', r1 - r0, '_', c1 - c0) AS raster_id, r0 AS row_off, row_idx - r0 AS row_idx, col_idx - c0 AS col_idx, CAST(value AS DOUBLE) AS value FROM lay JOIN z USING (k) WHERE x BETWEEN l AND r AND y BETWEEN b AND t AND value <> 0""")
def overlap_files(spark: SparkSession, d: str) -> DataFrame:
    """Every raster clipped to every overlap, each written as a raster of its own and read again (0 is nodata)."""
    pixels, grids = _layers(spark, d)
    clips = cut(ov.clip_overlaps(pixels, grids, 100.0), "clips").withColumn("raster_id", F.concat("raster_id", F.lit("_"), F.regexp_replace("name", r"\.tif$", "")))
    made = clips.groupBy("raster_id").agg(*[F.first(c).alias(c) for c in ("width", "height", "c", "f")]).withColumns({"a": F.lit(1.0), "e": F.lit(-1.0), "nodata": F.lit(0.0)})
    with scratch(spark, "overlaps") as folder:
        gt.write_rasters(clips, made, folder, "uint8", 64)
        read = gt.pixels_of(gt.read_rasters(spark, folder)).filter("value <> 0").select("raster_id", "row_idx", "col_idx", "value")
        source = F.substring("raster_id", 3, 1).cast("int")
        top = gt.read_grids(spark, folder).select("raster_id", (-5 * source - F.col("f")).cast("long").alias("row_off"))
        return cut(read.join(top, "raster_id").select("raster_id", "row_off", "row_idx", "col_idx", "value"), "read")


@query(f"""WITH {PX}, {_LAYER}, p AS (SELECT b.k, row_number() OVER (ORDER BY b.k) AS poly, greatest(a.l, b.l) AS l, greatest(a.b, b.b) AS b, least(a.r, b.r) AS r, least(a.t, b.t) AS t FROM foot3 a JOIN foot3 b ON a.k = 1 AND b.k <> 1)
SELECT concat('poly_', poly, '_T0', lay.k, 'MBN.tif') AS name, row_idx - CAST(-5 * lay.k - t AS BIGINT) AS row_idx, col_idx - CAST(l - 7 * lay.k AS BIGINT) AS col_idx, CAST(value AS DOUBLE) AS value
FROM lay JOIN p ON (lay.k = 1 OR lay.k = p.k) AND x BETWEEN l AND r AND y BETWEEN b AND t""")
def tile_overlap_clips(spark: SparkSession, d: str) -> DataFrame:
    """What a reference raster shares with each other one, clipped from both."""
    pixels, grids = _layers(spark, d)
    return ov.clip_reference(pixels, grids, "T01MBN_20170718", 100.0).select("name", "row_idx", "col_idx", "value")


# --- scenes -----------------------------------------------------------------------

#: Bands of a synthetic scene: file key -> column of the derived raster, at 10 m and at 20 m.
FINE = {"B02_10m": "blue", "B03_10m": "green", "B04_10m": "red", "B08_10m": "nir"}
COARSE = {"B02_20m": "blue", "B03_20m": "green", "B04_20m": "red", "B05_20m": "red", "B06_20m": "blue", "B07_20m": "green", "B8A_20m": "nir", "B11_20m": "swir", "B12_20m": "red", "SCL_20m": "scl"}
_SCENE = "T37MBN_20170718T075211_"


def write_scene(spark: SparkSession, d: str, folder: str) -> None:
    """Band files of a scene: the derived raster at 10 m, and its upper left quarter as if it were the scene at 20 m."""
    height = _height(spark, d)
    for place, keys, width, rows, size in (("R10m", FINE, 100, height // 2 * 2, 10.0), ("R20m", COARSE, 50, height // 2, 20.0)):
        part = bands(spark, d, *BANDS, "scl").filter((F.col("row_idx") < rows) & (F.col("col_idx") < width))
        every = F.explode(F.array(*[F.struct(F.lit(_SCENE + k).alias("raster_id"), F.col(c).cast("double").alias("value")) for k, c in keys.items()]))
        long = part.select("row_idx", "col_idx", F.lit(1).alias("band"), every.alias("s")).select("s.raster_id", "band", "row_idx", "col_idx", "s.value")
        row = (width, rows, size, -size, 500_000.0, 9_900_000.0, "EPSG:32737", None)
        gt.write_rasters(long, spark.createDataFrame([(_SCENE + k, *row) for k in keys], GRID), f"{folder}/{place}", "uint16", 64)
    picture = r.unstack(part.select("row_idx", "col_idx", *[F.col(b) % 256 for b in ("red", "green", "blue")]).toDF("row_idx", "col_idx", "r", "g", "b"), ["r", "g", "b"])
    gt.write_rasters(picture.withColumn("raster_id", F.lit(f"{_SCENE}TCI_20m")), spark.createDataFrame([(f"{_SCENE}TCI_20m", *row)], GRID), f"{folder}/R20m", "uint8", 64)


_FIRST = "f AS (SELECT * FROM px WHERE row_idx < (SELECT (max(row_idx) + 1) // 2 * 2 FROM px)), q AS (SELECT * FROM px WHERE row_idx < (SELECT (max(row_idx) + 1) // 2 FROM px) AND col_idx < 50)"


@query(f"""WITH {PX}, {_FIRST}, s AS (SELECT f.row_idx, f.col_idx, [f.blue, f.green, f.red, q.red, q.blue, q.green, f.nir, q.nir, q.swir, q.red] AS v FROM f JOIN q ON q.row_idx = f.row_idx // 2 AND q.col_idx = f.col_idx // 2 WHERE f.row_idx < 12 AND f.col_idx < 40)
SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS band, row_idx, col_idx, CAST(unnest(v) AS DOUBLE) AS value FROM s""")
def stack_script(spark: SparkSession, d: str) -> DataFrame:
    """Ten bands of a scene's files, six of them brought from 20 m to 10 m, a window of them in another order, written and read again."""
    keys = ["B02_10m", "B03_10m", "B04_10m", "B08_10m", "B05_20m", "B06_20m", "B07_20m", "B8A_20m", "B11_20m", "B12_20m"]
    with scratch(spark, "scene") as folder:
        write_scene(spark, d, folder)
        path = wf.stack_sent2_bands(spark, folder, keys, f"{folder}/out", area=(0, 0, 40, 12), order=[0, 1, 2, 4, 5, 6, 3, 7, 8, 9])
        return cut(gt.pixels_of(gt.read_rasters(spark, path)).select("band", "row_idx", "col_idx", "value"), "read")


_IDX = "CAST(trunc(coalesce(CAST({0} - {1} AS FLOAT) / nullif(CAST({0} + {1} AS FLOAT), 0), CAST(0 AS FLOAT)) * CAST(1000 AS FLOAT)) AS BIGINT)"


@query(f"""WITH {PX}, {_FIRST}, s AS (SELECT f.row_idx - 2 AS row_idx, f.col_idx - 10 AS col_idx, q.scl IN (3, 7, 8, 9, 10) AS m, f.red AS b4, f.nir AS b8, q.swir AS b11 FROM f JOIN q ON q.row_idx = f.row_idx // 2 AND q.col_idx = f.col_idx // 2 WHERE f.row_idx BETWEEN 2 AND 13 AND f.col_idx BETWEEN 10 AND 69),
k AS (SELECT row_idx, col_idx, CASE WHEN m THEN 9999 ELSE b4 END AS b4, CASE WHEN m THEN 9999 ELSE b8 END AS b8, CASE WHEN m THEN 9999 ELSE b11 END AS b11 FROM s),
v AS (SELECT row_idx, col_idx, [b4, b8, b11, {_IDX.format('b8', 'b4')}, {_IDX.format('b8', 'b11')}] AS v FROM k), u AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS band, row_idx, col_idx, unnest(v) AS value FROM v)
SELECT 'T37MBN_20170718' AS raster_id, band, row_idx, col_idx, CAST((value % 65536 + 65536) % 65536 AS DOUBLE) AS value FROM u""")
def scene_stack_files(spark: SparkSession, d: str) -> DataFrame:
    """Bands found by name in 10 m or 20 m files, brought to one grid, cut, masked by the classification, with indexes, written under tile and date and read again."""
    area = (10, 2, 60, 12)
    with scratch(spark, "scene") as folder:
        write_scene(spark, d, folder)
        clouds, _ = wf.read_band(spark, f"{folder}/R20m/{_SCENE}SCL_20m.tif", 10, area, None)
        mask = clouds.select("row_idx", "col_idx", r.mask_values("value", r.CLOUD_CLASSES).alias("masked"))
        indexes = {"ndvi": ("ndvi", ["B04_10m", "B08_10m"]), "nbr": ("nbr", ["B08_10m", "B11_20m"])}
        path = wf.stack_sent2_bands(spark, folder, ["B04_10m", "B08_10m", "B11_20m"], f"{folder}/out", mask=mask, area=area, indexes=indexes)
        return cut(gt.pixels_of(gt.read_rasters(spark, path)).select("raster_id", "band", "row_idx", "col_idx", "value"), "read")


@query(f"""WITH {POINTS}, {PX}, h AS (SELECT (max(row_idx) + 1) // 2 AS h FROM px), g AS (SELECT x, y FROM pts, h WHERE x < 95 AND y > -2 * h),
b AS (SELECT greatest(CAST(floor(min(x) / 2) AS BIGINT), 0) AS c0, least(CAST(ceil(max(x) / 2) AS BIGINT), 50) AS c1, greatest(CAST(floor(-max(y) / 2) AS BIGINT), 0) AS r0, least(CAST(ceil(-min(y) / 2) AS BIGINT), any_value(h)) AS r1 FROM g, h)
SELECT i AS row_idx, j AS col_idx, true AS known FROM b, range(100000) a(i), range(50) c(j) WHERE i < r1 - r0 AND j < c1 - c0""")
def classification_workflow(spark: SparkSession, d: str) -> DataFrame:
    """From the files of a scene and labelled points to a class map, read from the raster it is written as; one run of thirty.

    Which class a cell gets is a matter of the forest; all cells of the area
    around the points must have one of the training set's.
    """
    ground = points(spark, d).filter("x < 95").select("point_id", (F.col("x") * 10 + 500_000).alias("x"), (F.col("y") * 10 + 9_900_000).alias("y"), "classname", F.col("id").cast("int").alias("id"))
    with scratch(spark, "scene") as folder:
        write_scene(spark, d, folder)
        inside = ground.filter(F.col("y") > 9_900_000 - 10 * (_height(spark, d) // 2 * 2))
        _, path = wf.classify_scene(spark, folder, inside, f"{folder}/out", runs=1)
        stem = path.rsplit("/", 1)[1].removesuffix(".tif")
        top = inside.agg(F.max("id")).first()[0] + 1  # the class of masked pixels
        return cut(gt.pixels_of(gt.read_rasters(spark, f"{folder}/out/{stem}_classification_map__1.tif")).select("row_idx", "col_idx", F.col("value").between(1, top).alias("known")), "read")


@query(f"WITH {PX} SELECT row_idx * 2 + i AS row_idx, col_idx * 2 + j AS col_idx, CAST(scl IN (3, 7, 8, 9, 10) AS INTEGER) AS scl FROM px, range(2) a(i), range(2) b(j) WHERE row_idx < 4 AND col_idx < 20")
def workflow_sample(spark: SparkSession, d: str) -> DataFrame:
    """A document with the operations and outputs of the published sample."""
    document = {"mask_raster": {"inp": "scl.tif", "operations": {"resample_raster": {"scale": 2}, "get_aoi": {"window": [0, 0, 40, 8], "write": "_resampled_aoi.tiff"}, "binarize": {"values": [3, 7, 8, 9, 10], "write": "_mask_aoi.tiff"}}}}
    written: list[str] = []
    out = wf.pipeline_of(wf.WorkflowSpec(document), "mask_raster").run(bands(spark, d, "scl"), lambda df, name: written.append(name))
    if written != ["_resampled_aoi.tiff", "_mask_aoi.tiff"]:
        raise AssertionError(written)
    return out


# --- points and images ------------------------------------------------------------

_SEEN = f"""{POINTS}, {PX}, n AS (SELECT *, coalesce(CAST(nir - red AS FLOAT) / nullif(CAST(nir + red AS FLOAT), 0), CAST(0 AS FLOAT)) AS v FROM px),
seen AS (SELECT pts.*, n.row_idx // 32 AS tile_row, n.col_idx // 32 AS tile_col, NOT (v > 0.3) AND v <> 0 AS taken FROM pts JOIN n ON n.row_idx = floor(-pts.y) AND n.col_idx = floor(pts.x) WHERE pts.x > n.col_idx // 32 * 32 AND pts.y < -(n.row_idx // 32 * 32))"""


def _seen(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.functions.numeric import index_column

    value = index_column("ndvi", [F.col("red"), F.col("nir")], 1).cast("double")
    return sp.outside_cover(points(spark, d), bands(spark, d, "red", "nir"), value, UNIT, 32, 0.3)


@query(f"WITH {_SEEN} SELECT (SELECT count(*) FROM pts) AS total, count(*) AS found, count(*) FILTER (taken) AS taken, count(*) FILTER (NOT taken) AS excluded, count(DISTINCT (tile_row, tile_col)) FILTER (taken) AS blocks FROM seen")
def filter_shapes_counts(spark: SparkSession, d: str) -> DataFrame:
    return sp.cover_counts(points(spark, d), _seen(spark, d))


@query(f"""WITH {_SEEN}, b AS (SELECT DISTINCT tile_row, tile_col FROM seen WHERE taken)
SELECT 'point' AS kind, CAST(point_id AS VARCHAR) AS name, round(x, 9) AS x, round(y, 9) AS y FROM seen WHERE taken UNION ALL SELECT 'block', concat(tile_row, ' ', tile_col), CAST(tile_col * 32 AS DOUBLE), CAST(-(tile_row + 1) * 32 AS DOUBLE) FROM b""")
def filter_shapes_files(spark: SparkSession, d: str) -> DataFrame:
    """Points outside the canopy, and their blocks, each written as shapefiles and read again (a block by its lower left corner)."""
    from gridloom.functions.geometry import point_of

    taken = cut(_seen(spark, d).filter("taken"), "taken")
    dots = taken.select(F.col("point_id").alias("name"), vc.point_json(F.col("x"), F.col("y")).alias("geometry"))
    blocks = taken.select("tile_row", "tile_col").distinct()
    left, top = F.col("tile_col") * 32, -F.col("tile_row") * 32
    boxes = blocks.select(F.concat_ws(" ", "tile_row", "tile_col").alias("name"), vc.box_json(left, top - 32, left + 32, top).alias("geometry"))
    with scratch(spark, "shapes") as folder:
        vc.write_shapefile(dots, f"{folder}/points", "geometry", ["name"])
        vc.write_shapefile(boxes, f"{folder}/polys", "geometry", ["name"])
        back = vc.read_shapefile(spark, f"{folder}/points").select(F.lit("point").alias("kind"), F.col("properties.name").alias("name"), point_of(F.col("geometry")).alias("p"))
        corners = F.transform(F.regexp_extract_all("geometry", F.lit(r"(-?[0-9.]+) (-?[0-9.]+)"), F.lit(0)), lambda c: F.struct(F.split_part(c, F.lit(" "), F.lit(1)).cast("double").alias("x"), F.split_part(c, F.lit(" "), F.lit(2)).cast("double").alias("y")))
        shapes = vc.read_shapefile(spark, f"{folder}/polys").select(F.lit("block").alias("kind"), F.col("properties.name").alias("name"), F.array_min(corners).alias("p"))
        return cut(back.unionByName(shapes).select("kind", "name", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y")), "read")


_IMAGES = """im AS (SELECT s_suppkey AS k, s_suppkey // 5 AS grp, s_suppkey % 5 AS kind, concat('20200714_1033', lpad(CAST(s_suppkey // 5 AS VARCHAR), 4, '0'), '_ssc6_u0001_') AS info FROM supplier)"""


@query(f"""WITH {_IMAGES}, {FOOT}, udm AS (SELECT l_suppkey AS img, CASE WHEN l_quantity > 48 - (l_suppkey % 5) THEN 1 ELSE 0 END AS v FROM lineitem), c AS (SELECT img, v, count(*) AS n FROM udm GROUP BY 1, 2),
w AS (SELECT img, count(*) AS kinds, arg_max(n, v) AS high, sum(n) AS total, max(v) AS top FROM c GROUP BY 1), cover AS (SELECT img, CAST(CASE WHEN kinds = 1 AND top = 0 THEN 0.1 WHEN kinds = 2 THEN round_even(100 * high / CAST(total AS DOUBLE), 2) END AS DOUBLE) AS cc FROM w),
s AS (SELECT concat(i.info, 'analytic.tif') AS fname, i.k * 1234.0 AS size, cc FROM im i JOIN im m ON i.grp = m.grp AND i.kind = 0 AND m.kind = 2 JOIN cover ON img = m.k JOIN foot ON foot.id = i.k
  WHERE cc < 10 AND cc <> 0 AND EXISTS (SELECT 1 FROM events WHERE value BETWEEN "left" AND "right" AND user_id BETWEEN bottom AND top))
SELECT fname, cc AS cloud_pct, concat('File: ', fname, ': Size: ', CASE WHEN size < 1024 THEN printf('%3.1fB', size) WHEN size < 1048576 THEN printf('%3.1fKiB', size / 1024) WHEN size < 1073741824 THEN printf('%3.1fMiB', size / 1048576) END, ' CloudCoverage: ', CAST(cc AS VARCHAR)) AS line FROM s""")
def filter_images_report(spark: SparkSession, d: str) -> DataFrame:
    """Images over points whose quality mask, found by name, shows few clouds; the sorted report is written and read again."""
    assets = _assets(spark, d, spread=False)
    feet = footprints(spark, d)
    images = assets.filter(F.col("fname").endswith("analytic.tif")).withColumn("size_bytes", F.col("id") * 1234).join(feet, "id")
    own = assets.select(F.col("id").alias("img"), F.col("fname").alias("mask"))
    flags = cloud_flags(spark, d).join(own, "img").select("mask", F.col("v").alias("value"))
    dots = table(spark, d, "events").select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    found = cut(ct.images_over_points(images, ct.pair_quality_masks(assets, "id"), dots, flags, 10.0, 100.0), "images")
    with scratch(spark, "report") as folder:
        doc.write_lines(found, "line", ["cloud_pct", "fname"], f"{folder}/report")
        return cut(found.join(spark.read.text(f"{folder}/report").withColumnRenamed("value", "line"), "line").select("fname", "cloud_pct", "line"), "read")


@query("SELECT point_id, concat('POINT (', point_id, ')') AS label, CAST(point_id AS DOUBLE) / 4 AS x, -CAST(point_id AS DOUBLE) AS y FROM gdf_points WHERE point_id IS NOT NULL GROUP BY 1")
def vector_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points written as GeoJSON lines and read again."""
    from gridloom.functions.geometry import point_of

    ids = table(spark, d, "gdf_points").select("point_id").filter("point_id is not null").distinct()
    made = ids.select("point_id", F.concat(F.lit("POINT ("), F.col("point_id").cast("string"), F.lit(")")).alias("label"), vc.point_json(F.col("point_id") / 4, -F.col("point_id").cast("double")).alias("g"))
    with scratch(spark, "vector") as folder:
        vc.write_geojson(made, f"{folder}/points", "g", ["point_id", "label"])
        p = point_of(F.col("geometry"))
        back = vc.read_geojson(spark, f"{folder}/points", lines=True).select(F.col("properties.point_id").cast("long").alias("point_id"), F.col("properties.label").alias("label"), p.alias("p"))
        return cut(back.select("point_id", "label", "p.x", "p.y"), "read")


# --- names, labels and documents --------------------------------------------------


@query("""SELECT raster_id, concat(tile_n, '_', acq_date, '.tif') AS stack, concat(tile_n, '_', acq_date, '_stack.tif') AS masked_stack, concat(tile_n, '_', acq_date, '_AOI.tif') AS area, concat('poly_', band_count, '_', height, '_', width, '.tif') AS overlap,
concat('poly_', band_count, '_', tile_n, '.tif') AS tile_overlap, concat(raster_id, 'Corr.tif') AS corrected, concat(raster_id, '_training_data.json') AS training, concat(raster_id, '_classification_map__', band_count, '.json') AS class_map FROM rasters WHERE tile_n IS NOT NULL AND acq_date IS NOT NULL""")
def output_name_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The names of all kinds of outputs."""
    c = F.col
    columns = {"tile": c("tile_n"), "date": c("acq_date"), "poly": c("band_count"), "height": c("height"), "width": c("width"), "stem": c("raster_id"), "run": c("band_count")}
    kinds = ("stack", "masked_stack", "area", "overlap", "tile_overlap", "corrected", "training", "class_map")
    return table(spark, d, "rasters").filter("tile_n is not null and acq_date is not null").select("raster_id", *[output_name(k, **columns).alias(k) for k in kinds])


_DIM = "SELECT classname, min(CAST(CAST(trunc(try_cast(trim(id) AS DOUBLE)) AS INTEGER) AS VARCHAR)) AS id FROM labels_map WHERE classname IS NOT NULL GROUP BY 1"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "labels_map").select("classname", F.trim("id").try_cast("double").cast("int").cast("string").alias("id"))
    return sp.labels_map(named, "id")


@query(f"WITH m AS ({_DIM}) SELECT * FROM m WHERE classname <> (SELECT min(classname) FROM m) UNION ALL SELECT 'masked', '99'")
def labels_edit(spark: SparkSession, d: str) -> DataFrame:
    """A class added to the table of labels, one set anew, one deleted."""
    labels = _labels(spark, d)
    first = labels.agg(F.min("classname")).first()[0]
    return sp.set_label(sp.set_label(sp.delete_label(labels, first), "masked", 98), "masked", 99)


@query(f"WITH m AS ({_DIM}) SELECT classname, id FROM m")
def training_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of training documents, several of bounded size, as read from them."""
    return doc.training_labels(doc.training_documents(samples(spark, d), "vec_id", _labels(spark, d), 100))


@query("SELECT CAST(embedding[1] AS DOUBLE) AS b1, CAST(embedding[64] AS DOUBLE) AS b64, label FROM embeddings")
def training_documents(spark: SparkSession, d: str) -> DataFrame:
    """A training set as documents of at most a hundred samples, read again."""
    rows = doc.training_rows(doc.training_documents(samples(spark, d), "vec_id", _labels(spark, d), 100))
    return rows.select(F.col("features")[0].alias("b1"), F.col("features")[63].alias("b64"), "label")


@query("""SELECT v.pos, v.key, t.n FROM (VALUES (0, 'B04_20m'), (1, 'B99_10m'), (2, 'B02_10m')) v(pos, key) LEFT JOIN (SELECT concat(regexp_extract(fname, '_(B04_20m|B02_10m)', 1)) AS key, count(*) AS n FROM band_files WHERE regexp_matches(fname, '^T[0-9]{2}[^0-9]{3}_[0-9]{8}.*_(B04_20m|B02_10m)\\.') GROUP BY 1) t USING (key)""")
def lookup_missing(spark: SparkSession, d: str) -> DataFrame:
    """Requested bands with the number of their files, null for one that the catalogue does not have."""
    catalog = ct.scene_catalog(table(spark, d, "band_files").select("fname", "fpath"))
    counted = catalog.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return ct.lookup_all(counted, ["B04_20m", "B99_10m", "B02_10m"])


# --- classification ---------------------------------------------------------------


@query(f"""WITH {PRED}, a AS (SELECT truth AS v FROM pred UNION SELECT prediction FROM pred), kept AS (SELECT v FROM a ORDER BY v DESC LIMIT 1000000 OFFSET 2),
c AS (SELECT truth, prediction, count(*) AS n FROM pred WHERE truth IN (SELECT v FROM kept) AND prediction IN (SELECT v FROM kept) GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t, CAST(sum(CASE WHEN truth = prediction THEN n ELSE 0 END) AS DOUBLE) AS d FROM c),
r AS (SELECT truth AS v, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT prediction AS v, sum(n) AS k FROM c GROUP BY 1), s AS (SELECT CAST(sum(r * k) AS DOUBLE) AS s FROM r JOIN k USING (v)), h AS (SELECT truth AS v, n AS h FROM c WHERE truth = prediction),
e AS (SELECT v, CAST(r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS k, coalesce(h, 0) AS h FROM r FULL JOIN k USING (v) LEFT JOIN h USING (v))
SELECT 'confusion' AS metric, truth, prediction, CAST(n AS DOUBLE) AS value FROM c UNION ALL SELECT 'accuracy', NULL, NULL, round_even(d / t, 8) FROM t UNION ALL SELECT 'kappa', NULL, NULL, round_even(1 - (t - d) / ((t * t - s) / t), 8) FROM t, s
UNION ALL SELECT 'commission', v, NULL, round_even((r - h) / r, 2) FROM e UNION ALL SELECT 'user', v, NULL, round_even(h / r, 2) FROM e UNION ALL SELECT 'omission', v, NULL, round_even((k - h) / k, 2) FROM e UNION ALL SELECT 'producer', v, NULL, round_even(h / k, 2) FROM e""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of a classifier without its last two classes."""
    return cl.classification_report(predictions(spark, d), without=2)


class Larger:
    """A classifier from elsewhere: which of the first bands is the largest."""

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        return matrix[:, :3].argmax(axis=1)


@query(f"WITH {PX} SELECT row_idx, col_idx, CAST(CASE WHEN red >= nir AND red >= swir THEN 0 WHEN nir >= swir THEN 1 ELSE 2 END AS BIGINT) AS prediction FROM px")
def predict_custom(spark: SparkSession, d: str) -> DataFrame:
    """A foreign classifier applied to the grid in batches."""
    pixels = bands(spark, d, "red", "nir", "swir").select("row_idx", "col_idx", F.array("red", "nir", "swir").alias("features"))
    return cl.predict_batches(pixels, Larger()).select("row_idx", "col_idx", "prediction")


@query()
def rf_full_report(spark: SparkSession, d: str) -> DataFrame:
    """Confusion, scores and class errors of a forest, on its training rows and on the others."""
    return cl.full_report(cl.train_and_predict(samples(spark, d), "vec_id")[1])


def queries() -> dict:
    return reg.queries


def oracle_sql() -> dict:
    return reg.sql
