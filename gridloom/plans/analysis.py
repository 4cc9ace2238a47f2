"""Queries on catalogues, overlaps, calibration, samples, classification and workflows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import names as nm
from gridloom.functions.numeric import index_column
from gridloom.operators import calibration as cal
from gridloom.operators import classify as cl
from gridloom.operators import grid as g
from gridloom.operators import overlap as ov
from gridloom.operators import raster as r
from gridloom.operators import sampling as sp
from gridloom.plans import workflow as wf
from gridloom.plans.fixtures import BANDS, FOOT, PAIRS, POINTS, PRED, PX, S2, SCENE, UDM, UNIT, bands, cloud_flags, footprints, pairs, points, predictions, px, samples, scene_names
from gridloom.plans.registry import Registry
from gridloom.session import table
from gridloom.sources import catalog as ct
from gridloom.sources import documents as doc

reg = Registry()
query = reg.query

#: Runs of training and report, each with a forest of its own.
RUNS = 30

_PARSED = f"""SELECT pos, fname, regexp_extract(fname, {SCENE}, 1) AS tile_n, regexp_extract(fname, {SCENE}, 2) AS date, regexp_extract(fname, {SCENE}, 3) AS band,
  regexp_extract(fname, {SCENE}, 4) AS attr, concat(regexp_extract(fname, {SCENE}, 3), regexp_extract(fname, {SCENE}, 4)) AS "key" FROM s2 WHERE regexp_matches(fname, {SCENE})"""


# --- catalogues -----------------------------------------------------------------


@query(f"WITH {S2} {_PARSED}")
def s2_catalog(spark: SparkSession, d: str) -> DataFrame:
    return ct.scene_catalog(scene_names(spark, d)).select("pos", "fname", "tile_n", "date", "band", "attr", "key")


@query(f"""SELECT file_id, regexp_extract(fname, {SCENE}, 1) AS tile_n, regexp_extract(fname, {SCENE}, 2) AS date, regexp_extract(fname, {SCENE}, 3) AS band, regexp_extract(fname, {SCENE}, 4) AS attr
FROM band_files WHERE regexp_matches(fname, {SCENE})""")
def band_files_catalog(spark: SparkSession, d: str) -> DataFrame:
    return ct.scene_catalog(table(spark, d, "band_files")).select("file_id", "tile_n", "date", "band", "attr")


@query(f"""WITH p AS (SELECT regexp_extract(fname, {SCENE}, 1) AS tile_n, regexp_extract(fname, {SCENE}, 2) AS date, concat(regexp_extract(fname, {SCENE}, 3), regexp_extract(fname, {SCENE}, 4)) AS "key", fpath, file_id
  FROM band_files WHERE regexp_matches(fname, {SCENE})) SELECT tile_n, date, "key", arg_max(fpath, file_id) AS fpath, max(file_id) AS file_id FROM p GROUP BY 1, 2, 3""")
def s2_lookup_last(spark: SparkSession, d: str) -> DataFrame:
    """The file of every key of a scene; the last listed wins."""
    catalog = ct.scene_catalog(table(spark, d, "band_files").select("fname", "fpath", "file_id")).select("tile_n", "date", "key", "fpath", "file_id")
    return ct.last_of_key(catalog, ["tile_n", "date"], "file_id")


_WANTED = ["B04_20m", "B8A_20m", "B02_10m"]


@query(f"""WITH {S2}, p AS ({_PARSED}) SELECT list_position(['B04_20m', 'B8A_20m', 'B02_10m'], "key") - 1 AS pos, "key", fname FROM p WHERE "key" IN ('B04_20m', 'B8A_20m', 'B02_10m')""")
def s2_lookup_ordered(spark: SparkSession, d: str) -> DataFrame:
    return ct.lookup(ct.scene_catalog(scene_names(spark, d)), _WANTED).select(F.col("pos").cast("int"), "key", "fname").orderBy("pos", "fname")


@query(f"""SELECT regexp_extract(fname, {SCENE}, 1) AS tile_n, regexp_extract(fname, {SCENE}, 2) AS date, regexp_extract(fname, {SCENE}, 3) AS band, count(*) AS n
FROM band_files WHERE regexp_matches(fname, {SCENE}) AND regexp_extract(fname, {SCENE}, 4) = '' GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def s2_duplicate_bands(spark: SparkSession, d: str) -> DataFrame:
    return ct.duplicate_bands(ct.scene_catalog(table(spark, d, "band_files").select("fname")), ["tile_n", "date"])


_FALL = "'B02', 'B05', 'B11'"


@query(f"""WITH p AS (SELECT regexp_extract(fname, {SCENE}, 1) AS tile_n, regexp_extract(fname, {SCENE}, 2) AS date, regexp_extract(fname, {SCENE}, 3) AS band, fpath FROM band_files WHERE regexp_matches(fname, {SCENE})),
a AS (SELECT * FROM p WHERE fpath LIKE '%/R10m/%'), b AS (SELECT * FROM p WHERE fpath LIKE '%/R20m/%'),
w AS (SELECT tile_n, date, band FROM (SELECT tile_n, date FROM a UNION SELECT tile_n, date FROM b) s, unnest([{_FALL}]) AS u(band)),
x AS (SELECT tile_n, date, band, min(fpath) AS p FROM a GROUP BY 1, 2, 3), y AS (SELECT tile_n, date, band, min(fpath) AS p FROM b GROUP BY 1, 2, 3)
SELECT tile_n, date, band, coalesce(x.p, y.p) AS fpath, CAST(CASE WHEN x.p IS NOT NULL THEN 1 WHEN y.p IS NOT NULL THEN 2 END AS INTEGER) AS resolved_in
FROM w LEFT JOIN x USING (tile_n, date, band) LEFT JOIN y USING (tile_n, date, band)""")
def s2_band_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Bands looked up in the 10 m files of a scene, else in the 20 m files."""
    catalog = ct.scene_catalog(table(spark, d, "band_files").select("fname", "fpath"))
    fine, coarse = catalog.filter(F.col("fpath").contains("/R10m/")), catalog.filter(F.col("fpath").contains("/R20m/"))
    return ct.band_fallback(fine, coarse, ["tile_n", "date"], ["B02", "B05", "B11"])


@query(f"WITH {S2} SELECT pos, fname FROM s2 WHERE regexp_matches(fname, '^T[0-9].*_B0[2-4]_.*\\.jp2$')")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return ct.matching(scene_names(spark, d), "T[0-9]*_B0[2-4]_*.jp2")


_ASSETS = """assets AS (SELECT s_suppkey AS id, concat('20200', CAST(100 + s_suppkey % 9 AS VARCHAR), '_1033', lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0'), '_ssc', CAST(s_suppkey // 50 % 7 AS VARCHAR), '_u0001_',
  ['analytic.tif', 'ortho_panchromatic.tif', 'ortho_udm2.tif', 'panchromatic_udm2.tif', 'basic_udm2_a_b.tif'][CAST(s_suppkey % 5 AS INTEGER) + 1]) AS fname FROM supplier)"""


def _assets(spark: SparkSession, d: str, spread: bool = True) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("analytic.tif", "ortho_panchromatic.tif", "ortho_udm2.tif", "panchromatic_udm2.tif", "basic_udm2_a_b.tif")])
    s = table(spark, d, "supplier").select("s_suppkey")
    kind = F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int"))
    if spread:
        info = F.concat(F.lit("20200"), (100 + F.col("s_suppkey") % 9).cast("string"), F.lit("_1033"), F.lpad((F.col("s_suppkey") % 50).cast("string"), 2, "0"), F.lit("_ssc"), F.expr("cast(s_suppkey div 50 % 7 as string)"), F.lit("_u0001_"))
    else:
        info = F.concat(F.lit("20200714_1033"), F.lpad(F.expr("cast(s_suppkey div 5 as string)"), 4, "0"), F.lit("_ssc6_u0001_"))
    name = F.concat(info, kind)
    return s.select(F.col("s_suppkey").alias("id"), name.alias("fname"), F.concat(F.lit("/store/"), name).alias("fpath"))


@query(f"""WITH {_ASSETS} SELECT fname, split_part(CASE WHEN len(p) = 6 THEN concat(p[5], '_', p[6]) ELSE p[5] END, '.', 1) AS asset, concat_ws('_', p[1], p[2], p[3], p[4]) AS info
FROM (SELECT fname, string_split(fname, '_') AS p FROM assets) t""")
def file_info_split(spark: SparkSession, d: str) -> DataFrame:
    return _assets(spark, d).select("fname").withColumns(nm.asset_fields(F.col("fname")))


@query("""WITH k AS (SELECT s_suppkey // 5 AS grp, s_suppkey % 5 AS kind FROM supplier), n AS (SELECT concat('20200714_1033', lpad(CAST(grp AS VARCHAR), 4, '0'), '_ssc6_u0001_') AS info, kind FROM k)
SELECT concat(i.info, CASE i.kind WHEN 0 THEN 'analytic.tif' ELSE 'ortho_panchromatic.tif' END) AS fname, concat(m.info, CASE m.kind WHEN 2 THEN 'ortho_udm2.tif' ELSE 'panchromatic_udm2.tif' END) AS mask
FROM n i JOIN n m ON i.info = m.info AND ((i.kind = 0 AND m.kind = 2) OR (i.kind = 1 AND m.kind = 3))""")
def udm_pairing(spark: SparkSession, d: str) -> DataFrame:
    return ct.pair_quality_masks(_assets(spark, d, spread=False), "id")


_COVER = f"""WITH {UDM}, c AS (SELECT img, v, count(*) AS n FROM udm GROUP BY 1, 2), w AS (SELECT img, count(*) AS kinds, arg_max(n, v) AS high, sum(n) AS total, max(v) AS top FROM c GROUP BY 1),
cover AS (SELECT img, CASE WHEN kinds = 1 AND top = 0 THEN 0.1 WHEN kinds = 2 THEN round_even(100 * high / CAST(total AS DOUBLE), 2) END AS cloud_pct FROM w)"""


@query(_COVER + " SELECT img, CAST(cloud_pct AS DOUBLE) AS cloud_pct FROM cover")
def cloud_cover(spark: SparkSession, d: str) -> DataFrame:
    return ct.cloud_cover(cloud_flags(spark, d), "img", "v")


@query(_COVER + " SELECT img, CAST(cloud_pct AS DOUBLE) AS cloud_pct FROM cover WHERE cloud_pct < 5 AND cloud_pct <> 0 ORDER BY cloud_pct, img")
def cloud_cover_sorted(spark: SparkSession, d: str) -> DataFrame:
    return ct.clear_images(ct.cloud_cover(cloud_flags(spark, d), "img", "v"), 5.0).orderBy("cloud_pct", "img")


@query(_COVER + " SELECT printf('%.2f %d', CAST(cloud_pct AS DOUBLE), img) AS line FROM cover WHERE cloud_pct < 5 AND cloud_pct <> 0")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    clear = ct.clear_images(ct.cloud_cover(cloud_flags(spark, d), "img", "v"), 5.0)
    return clear.select(F.format_string("%.2f %d", "cloud_pct", "img").alias("line"))


@query("""SELECT file_id, CASE WHEN size_bytes IS NULL THEN NULL WHEN abs(size_bytes) < 1024 THEN printf('%3.1fB', CAST(size_bytes AS DOUBLE)) WHEN abs(size_bytes) / 1024.0 < 1024 THEN printf('%3.1fKiB', CAST(size_bytes AS DOUBLE) / 1024)
WHEN abs(size_bytes) / 1048576.0 < 1024 THEN printf('%3.1fMiB', CAST(size_bytes AS DOUBLE) / 1048576) ELSE printf('%3.1fGiB', CAST(size_bytes AS DOUBLE) / 1073741824) END AS size_text FROM band_files""")
def size_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "band_files").select("file_id", nm.size_text(F.col("size_bytes")).alias("size_text"))


@query("""WITH p AS (SELECT poly_name, try_cast(regexp_replace(poly_name, '[^0-9]', '', 'g') AS BIGINT) AS n, poly_id FROM overlap_polys WHERE poly_name IS NOT NULL),
a AS (SELECT poly_name, row_number() OVER (ORDER BY n, poly_id) AS pos FROM p WHERE poly_id % 2 = 0), b AS (SELECT poly_name, row_number() OVER (ORDER BY n, poly_id) AS pos FROM p WHERE poly_id % 2 = 1)
SELECT a.pos, a.poly_name AS reference, b.poly_name AS target FROM a JOIN b USING (pos)""")
def digit_sort_zip(spark: SparkSession, d: str) -> DataFrame:
    """Polygon files of two lists, both in the order of their digits, paired by position."""
    p = table(spark, d, "overlap_polys").filter("poly_name is not null").select("poly_id", F.col("poly_name").alias("fname"), F.struct(nm.digits(F.col("poly_name")).alias("n"), "poly_id").alias("at"))
    return ct.pair_by_digits(p.filter("poly_id % 2 = 0"), p.filter("poly_id % 2 = 1"), "at")


@query(f"WITH {S2} SELECT pos, concat(left(fname, 6), '_', substr(fname, 8, 8), '.tif') AS out_name FROM s2")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    stem = nm.stem(F.col("fname"))
    return scene_names(spark, d).select("pos", F.concat(F.concat_ws("_", F.substring(stem, 1, 6), F.substring(stem, 8, 8)), F.lit(".tif")).alias("out_name"))


@query(f"""{_COVER}, i AS (SELECT s_suppkey AS img, (s_suppkey % 10) * 90 AS l, (s_suppkey // 10) * 90 AS b FROM supplier)
SELECT img, CAST(cloud_pct AS DOUBLE) AS cloud_pct, printf('%.2f %d', CAST(cloud_pct AS DOUBLE), img) AS line FROM cover JOIN i USING (img)
WHERE cloud_pct < 10 AND cloud_pct <> 0 AND EXISTS (SELECT 1 FROM events WHERE value BETWEEN l AND l + 100 AND user_id BETWEEN b AND b + 100)""")
def filter_images_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Images over at least one point and with few clouds, sorted, with their report lines."""
    over = image_semi_join(spark, d).select(F.col("id").alias("img"))
    clear = ct.clear_images(ct.cloud_cover(cloud_flags(spark, d), "img", "v"), 10.0).join(over, "img", "left_semi")
    return clear.withColumn("line", F.format_string("%.2f %d", "cloud_pct", "img")).orderBy("cloud_pct", "img")


@query()
def rf_report(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on training and test rows of thirty runs with their own seeds."""
    return cl.repeated_runs(samples(spark, d), "vec_id", RUNS)


@query(f"WITH {POINTS} SELECT point_id, x, y FROM pts WHERE x BETWEEN 10 AND 60 AND y BETWEEN -40.5 AND -3.25")
def clip_points(spark: SparkSession, d: str) -> DataFrame:
    return sp.clip_points(points(spark, d), 10.0, -40.5, 60.0, -3.25).select("point_id", "x", "y")


# --- overlaps -------------------------------------------------------------------

_MEET = 'a."left" <= b."right" AND b."left" <= a."right" AND a.bottom <= b.top AND b.bottom <= a.top'
_BOX = 'greatest(a."left", b."left") AS "left", greatest(a.bottom, b.bottom) AS bottom, least(a."right", b."right") AS "right", least(a.top, b.top) AS top'


@query(f"""WITH {FOOT}, p AS (SELECT a.id AS i, b.id AS j, {_BOX} FROM foot a JOIN foot b ON a.id < b.id AND {_MEET}), f AS (SELECT "left", bottom, "right", top, min((i, j)) AS k FROM p GROUP BY ALL)
SELECT row_number() OVER (ORDER BY k) AS poly_id, "left", bottom, "right", top FROM f""")
def pairwise_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return ov.pairwise_overlaps(footprints(spark, d), 100.0)


@query(f"WITH {FOOT} SELECT b.id, {_BOX} FROM foot a JOIN foot b ON a.id = 5 AND b.id <> 5 AND {_MEET}")
def ref_tile_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return ov.reference_overlaps(footprints(spark, d), 5, 100.0)


@query(f"""WITH {FOOT}, {PX}, p AS (SELECT b.id, {_BOX} FROM foot a JOIN foot b ON a.id = 0 AND b.id <> 0 AND {_MEET})
SELECT p.id AS box, row_idx, col_idx, red FROM px JOIN p ON col_idx + 0.5 BETWEEN p."left" AND p."right" AND -(row_idx + 0.5) BETWEEN -p.top AND -p.bottom""")
def overlap_clip(spark: SparkSession, d: str) -> DataFrame:
    """The pixels that one tile shares with each tile it meets."""
    shared = ov.reference_overlaps(footprints(spark, d), 0, 100.0)
    flipped = shared.select("id", "left", (-F.col("top")).alias("bottom"), "right", (-F.col("bottom")).alias("top"))
    return ov.cells_in_boxes(bands(spark, d, "red"), flipped, 50).select("box", "row_idx", "col_idx", "red")


# --- calibration ----------------------------------------------------------------

_RANGE = "rg AS (SELECT band, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pairs GROUP BY 1)"
_NX, _NY = "(x - x0) / nullif(CAST(x1 - x0 AS DOUBLE), 0)", "(y - y0) / nullif(CAST(y1 - y0 AS DOUBLE), 0)"
_MODEL = f"WITH {PAIRS}, {_RANGE}, m AS (SELECT band, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, round_even(avg(abs({_NX} - {_NY})), 5) AS mean_diff FROM pairs JOIN rg USING (band) GROUP BY 1)"


@query(f"WITH {PAIRS}, {_RANGE} SELECT CAST(band AS INTEGER) AS band, row_idx, col_idx, round({_NX}, 9) AS nx, round({_NY}, 9) AS ny, round(abs({_NX} - {_NY}), 9) AS diff FROM pairs JOIN rg USING (band)")
def minmax_diff(spark: SparkSession, d: str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("nx", "ny", "diff")]
    return cal.minmax_difference(pairs(spark, d)).select("band", "row_idx", "col_idx", *rounded)


@query(_MODEL + " SELECT CAST(band AS INTEGER) AS band, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 8) AS r2, mean_diff FROM m")
def band_regression(spark: SparkSession, d: str) -> DataFrame:
    return cal.band_models(pairs(spark, d)).select("band", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "mean_diff")


@query(_MODEL + " SELECT CAST(band AS INTEGER) AS band, round(slope, 6) AS slope, round(intercept, 4) AS intercept, mean_diff FROM m WHERE mean_diff > 0.005")
def bands_correlation(spark: SparkSession, d: str) -> DataFrame:
    return cal.bands_correlation(pairs(spark, d)).select("band", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "mean_diff")


#: Normal equations of the centred and scaled x, solved by determinants.
_DET = "{0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6})"
_D0, _D1, _D2 = (_DET.format(*m) for m in (("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"), ("n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), ("n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2")))


@query(f"""WITH {PAIRS}, st AS (SELECT band, avg(x) AS m, stddev_pop(x) AS s FROM pairs GROUP BY 1), z AS (SELECT band, m, s, (x - m) / s AS z, y FROM pairs JOIN st USING (band)),
k AS (SELECT band, m, s, CAST(count(*) AS DOUBLE) AS n, sum(z) AS s1, sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4, CAST(sum(y) AS DOUBLE) AS t0, sum(z * y) AS t1, sum(z * z * y) AS t2 FROM z GROUP BY 1, 2, 3),
c AS (SELECT band, m, s, ({_D0}) / d AS c0, ({_D1}) / d AS c1, ({_D2}) / d AS c2 FROM (SELECT *, {_DET.format('n', 's1', 's2', 's1', 's2', 's3', 's2', 's3', 's4')} AS d FROM k) q)
SELECT CAST(band AS INTEGER) AS band, CAST(unnest([0, 1, 2]) AS INTEGER) AS power, round(unnest([c0 - c1 * m / s + c2 * m * m / (s * s), c1 / s - 2 * c2 * m / (s * s), c2 / (s * s)]), 4) + 0.0 AS coefficient FROM c""")
def poly_degree2(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic fit per band."""
    return cal.polynomial_fit(pairs(spark, d), 2).select("band", "power", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


@query(f"WITH {PAIRS}, m AS (SELECT band, regr_r2(y, x) AS r2 FROM pairs GROUP BY 1) SELECT CAST(band AS INTEGER) AS band, round(r2, 8) AS r2 FROM m")
def band_r2(spark: SparkSession, d: str) -> DataFrame:
    """R squared of the fitted models, by the general definition for any model."""
    p = pairs(spark, d)
    return cal.r_squared(p, cal.band_models(p)).select("band", F.round("r2", 8).alias("r2"))


@query(f"WITH {PAIRS}, m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS b FROM pairs WHERE band = 1) SELECT row_idx, col_idx, round(s * x - b, 4) AS line FROM pairs, m WHERE band = 1")
def fitted_line(spark: SparkSession, d: str) -> DataFrame:
    """The plotted line of a model, which subtracts the intercept."""
    one = pairs(spark, d).filter("band = 1")
    joined = one.join(cal.band_models(one).select("band", "slope", "intercept"), "band")
    return joined.select("row_idx", "col_idx", F.round(cal.line(F.col("slope"), F.col("x"), F.col("intercept")), 4).alias("line"))


_FIXED = "CASE WHEN value - 100.5 < 0 THEN value ELSE CAST(trunc(value - 100.5) AS BIGINT) END"


@query(f"WITH {PX} SELECT row_idx, col_idx, {_FIXED.replace('value', 'red')} AS red FROM px")
def array_correction(spark: SparkSession, d: str) -> DataFrame:
    return bands(spark, d, "red").select("row_idx", "col_idx", cal.corrected(F.col("red"), F.lit(100.5)).alias("red"))


@query(f"WITH {PX}, l AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS band, row_idx, col_idx, unnest([red, nir, swir]) AS value FROM px) SELECT band, row_idx, col_idx, CASE WHEN band = 2 THEN value ELSE {_FIXED} END AS value FROM l")
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Bands 1 and 3 have a model, band 2 passes through."""
    models = spark.createDataFrame([(1, 100.5), (3, 100.5)], "band int, intercept double")
    return cal.apply_corrections(r.unstack(bands(spark, d, "red", "nir", "swir"), ["red", "nir", "swir"]), models).select("band", "row_idx", "col_idx", "value")


@query(_MODEL + """, c AS (SELECT band, round(intercept, 6) AS b FROM m WHERE mean_diff > 0.005) SELECT CAST(band AS INTEGER) AS band, row_idx, col_idx,
CASE WHEN b IS NULL OR y - b < 0 THEN y ELSE CAST(trunc(y - b) AS BIGINT) END AS value FROM pairs LEFT JOIN c USING (band)""")
def calibration_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Fit target on reference per band, keep the models that matter, correct the target."""
    p = pairs(spark, d)
    models = cal.bands_correlation(p).withColumn("intercept", F.round("intercept", 6))
    return cal.apply_corrections(p.select("band", "row_idx", "col_idx", F.col("y").alias("value")), models).select("band", "row_idx", "col_idx", "value")


# --- samples --------------------------------------------------------------------

_AT = "JOIN px ON px.row_idx = floor((pts.y - 0) / -1) AND px.col_idx = floor((pts.x - 0) / 1)"


@query(f"WITH {POINTS}, {PX} SELECT point_id, classname, row_idx, col_idx, red, nir FROM pts {_AT}")
def points_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    return sp.points_to_pixels(points(spark, d), bands(spark, d, "red", "nir"), UNIT).select("point_id", "classname", "row_idx", "col_idx", "red", "nir")


@query(f"""WITH {POINTS}, {PX}, m AS (SELECT row_idx, col_idx, {', '.join(f'CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 9999 ELSE {b} END AS {b}' for b in BANDS)} FROM px)
SELECT point_id, CAST(id AS INTEGER) AS label, CAST(red AS DOUBLE) AS b1, CAST(nir AS DOUBLE) AS b2 FROM pts {_AT.replace('px', 'm')} WHERE NOT (red = 9999 AND nir = 9999)""")
def extract_xy(spark: SparkSession, d: str) -> DataFrame:
    masked = r.apply_mask(bands(spark, d, "red", "nir", "scl"), ["red", "nir"], r.mask_values("scl", r.CLOUD_CLASSES), r.FILL)
    got = sp.extract(points(spark, d), masked, ["red", "nir"], UNIT)
    return got.select("point_id", "label", F.col("features")[0].alias("b1"), F.col("features")[1].alias("b2"))


@query(f"""WITH {POINTS}, {PX}, n AS (SELECT *, {'coalesce(CAST(nir - red AS FLOAT) / nullif(CAST(nir + red AS FLOAT), 0), CAST(0 AS FLOAT))'} AS v FROM px)
SELECT DISTINCT n.row_idx // 32 AS tile_row, n.col_idx // 32 AS tile_col FROM pts {_AT.replace('px', 'n')} WHERE NOT (v > 0.3) AND v <> 0 AND pts.x > n.col_idx // 32 * 32 AND pts.y < -(n.row_idx // 32 * 32)""")
def points_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with a point strictly inside that sees little vegetation; a value of 0 does not count."""
    value = index_column("ndvi", [F.col("red"), F.col("nir")], 1).cast("double")
    seen = sp.points_to_pixels(points(spark, d), bands(spark, d, "red", "nir"), UNIT).withColumn("v", value)
    tile_row, tile_col = F.floor(F.col("row_idx") / 32), F.floor(F.col("col_idx") / 32)
    inside = g.strictly_within(F.col("x"), F.col("y"), tile_col * 32, -(tile_row + 1) * 32, (tile_col + 1) * 32, -(tile_row * 32))
    return seen.filter(~(F.col("v") > 0.3) & (F.col("v") != 0) & inside).select(tile_row.alias("tile_row"), tile_col.alias("tile_col")).distinct()


@query(f"""WITH {FOOT} SELECT id FROM foot WHERE EXISTS (SELECT 1 FROM events WHERE value >= "left" AND value <= "right" AND user_id >= bottom AND user_id <= top)""")
def image_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Footprints that hold at least one point: cells first, then the exact test, each footprint once."""
    e = table(spark, d, "events").select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    dots = e.distinct().select(F.xxhash64("x", "y").alias("id"), F.col("x").alias("left"), F.col("y").alias("bottom"), F.col("x").alias("right"), F.col("y").alias("top"))
    return ov.box_semi(footprints(spark, d), dots, 100.0)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return sp.class_counts(samples(spark, d), "label")


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), a AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS b1 FROM embeddings
UNION ALL SELECT CAST((SELECT max(label) + 1 FROM c) AS INTEGER), 9999.0 FROM range(10000000) t(i) WHERE i < (SELECT max(n) FROM c)) SELECT label, count(*) AS n, round(sum(b1), 4) AS total FROM a GROUP BY 1""")
def add_class(spark: SparkSession, d: str) -> DataFrame:
    """A constant class added, then the counts and sums of all classes."""
    made = sp.add_class(samples(spark, d), 64, 9999.0)
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def remove_class(spark: SparkSession, d: str) -> DataFrame:
    return sp.remove_class(samples(spark, d), 3).select("vec_id", "label")


@query("SELECT " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS Band{i}" for i in range(1, 65)) + ", label AS labels FROM embeddings")
def to_band_df(spark: SparkSession, d: str) -> DataFrame:
    return sp.band_columns(samples(spark, d), 64)


@query("SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 7) AS BIGINT) AS chunk FROM embeddings")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    return sp.chunks(table(spark, d, "embeddings").select("vec_id"), "vec_id", 7)


@query("SELECT s_nationkey AS grp, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey")
def pairs_front(spark: SparkSession, d: str) -> DataFrame:
    return sp.front_pairs(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("grp")), "s_suppkey")


@query("SELECT label, CAST(ceil(count(*) * 0.3) AS BIGINT) AS test, count(*) - CAST(ceil(count(*) * 0.3) AS BIGINT) AS train FROM embeddings GROUP BY 1")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of an exact 30 % split; which rows are drawn is a matter of the seed."""
    made = sp.stratified_split(samples(spark, d).select("vec_id", "label"), "vec_id", "label", 0.3)
    return made.groupBy("label").agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))


@query("""SELECT classname, min(CAST(trunc(try_cast(trim(id) AS DOUBLE)) AS INTEGER)) AS id FROM labels_map WHERE classname IS NOT NULL GROUP BY 1""")
def labels_dimension(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "labels_map").select("classname", F.trim("id").try_cast("double").cast("int").alias("id"))
    return sp.labels_map(named, "id").select("classname", F.col("id").cast("int").alias("id"))


@query("""SELECT sample_id, y, CAST(len(x) AS INTEGER) AS bands, CAST(len(list_filter(x, lambda v: v = 9999)) AS INTEGER) AS masked FROM extractor_samples WHERE x IS NOT NULL AND NOT (len(x) > 0 AND list_bool_and(list_transform(x, lambda v: v IS NOT NULL AND v = 9999))) AND len(x) > 0""")
def usable_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples kept by the all-bands-masked rule; empty vectors hold no band and are left out."""
    return table(spark, d, "extractor_samples").filter((F.size("x") > 0) & ~sp.all_masked(F.col("x"))).select("sample_id", "y", F.size("x").alias("bands"), F.size(F.filter("x", lambda v: v == sp.MASK)).alias("masked"))


# --- classification ---------------------------------------------------------------


@query(f"WITH {PRED}, l AS (SELECT truth AS v FROM pred UNION SELECT prediction FROM pred), c AS (SELECT truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2) SELECT a.v AS truth, b.v AS prediction, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON truth = a.v AND prediction = b.v")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cl.dense_confusion(predictions(spark, d))


@query(f"WITH {PRED}, l AS (SELECT truth AS v FROM pred UNION SELECT prediction FROM pred), k AS (SELECT v FROM l ORDER BY v DESC LIMIT 1000000 OFFSET 2), c AS (SELECT truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2) SELECT a.v AS truth, b.v AS prediction, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON truth = a.v AND prediction = b.v")
def confusion_without_last(spark: SparkSession, d: str) -> DataFrame:
    """The matrix without its last two classes, as the original report has it."""
    return cl.without_last_classes(cl.dense_confusion(predictions(spark, d)))


@query(f"""WITH {PRED}, c AS (SELECT truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t, CAST(sum(CASE WHEN truth = prediction THEN n ELSE 0 END) AS DOUBLE) AS d FROM c),
r AS (SELECT truth AS v, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT prediction AS v, sum(n) AS k FROM c GROUP BY 1), s AS (SELECT CAST(sum(r * k) AS DOUBLE) AS s FROM r JOIN k USING (v))
SELECT round_even(d / t, 8) AS accuracy, round_even(1 - (t - d) / ((t * t - s) / t), 8) AS kappa FROM t, s""")
def accuracy_kappa(spark: SparkSession, d: str) -> DataFrame:
    return cl.accuracy_kappa(predictions(spark, d))


@query(f"""WITH {PRED}, c AS (SELECT truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2), r AS (SELECT truth AS label, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT prediction AS label, sum(n) AS k FROM c GROUP BY 1), h AS (SELECT truth AS label, n AS h FROM c WHERE truth = prediction)
SELECT label, round_even((r - coalesce(h, 0)) / CAST(r AS DOUBLE), 2) AS commission, round_even(coalesce(h, 0) / CAST(r AS DOUBLE), 2) AS "user", round_even((k - coalesce(h, 0)) / CAST(k AS DOUBLE), 2) AS omission, round_even(coalesce(h, 0) / CAST(k AS DOUBLE), 2) AS producer
FROM r FULL JOIN k USING (label) LEFT JOIN h USING (label)""")
def class_errors(spark: SparkSession, d: str) -> DataFrame:
    return cl.class_errors(predictions(spark, d))


@query()
def rf_predict(spark: SparkSession, d: str) -> DataFrame:
    """A forest on 70 % of the samples, its predictions of the other 30 %."""
    split = sp.stratified_split(samples(spark, d), "vec_id", "label", 0.3)
    model = cl.train_forest(split.filter("not is_test"))
    return cl.predict(split.filter("is_test"), model).select("vec_id", F.col("label").alias("truth"), "prediction")


@query()
def predict_map(spark: SparkSession, d: str) -> DataFrame:
    """A forest on pixels under labelled points, applied to the whole grid; one JSON array per row."""
    grid = bands(spark, d, "red", "nir", "swir")
    training = sp.extract(points(spark, d), grid, ["red", "nir", "swir"], UNIT)
    model = cl.train_forest(training)
    pixels = grid.select("row_idx", "col_idx", F.array(*[F.col(b).cast("double") for b in ("red", "nir", "swir")]).alias("features"))
    return doc.class_map_rows(cl.predict(pixels, model))


# --- documents and workflows ------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS pos, CAST(embedding[1] AS DOUBLE) AS b1, CAST(embedding[64] AS DOUBLE) AS b64, label FROM embeddings")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The training set written as doubly encoded documents of bounded size and read again in order."""
    document = doc.training_documents(samples(spark, d), "vec_id", table(spark, d, "labels_map").filter("classname is not null"), 1000)
    return doc.training_rows(document, 1000).select("pos", F.col("features")[0].alias("b1"), F.col("features")[63].alias("b64"), "label")


@query(f"WITH {PX} SELECT row_idx, to_json(list(scl ORDER BY col_idx)) AS \"values\" FROM px GROUP BY 1")
def class_map_json(spark: SparkSession, d: str) -> DataFrame:
    return doc.class_map_rows(bands(spark, d, "scl").withColumnRenamed("scl", "prediction"))


#: A document like those that drive the original scripts.
DOCUMENT = {"mask_raster": {"inp": "scl.tif", "out": "mask.tif", "operations": {"get_aoi": {"window": [10, 2, 40, 8]}, "resample": {"scale": 2}, "binarize": {"values": [3, 7, 8, 9, 10]}}}}


@query("""WITH t(task, attribute, value) AS (VALUES ('mask_raster', 'inp', 'scl.tif'), ('mask_raster', 'out', 'mask.tif'), ('mask_raster', 'operations', 'get_aoi,resample,binarize')) SELECT * FROM t""")
def workflow_parse(spark: SparkSession, d: str) -> DataFrame:
    spec = wf.WorkflowSpec(json.loads(json.dumps(DOCUMENT)))
    rows = [(t, a, v) for t in spec.tasks() for a, v in (("inp", spec.source(t)), ("out", spec.target(t)), ("operations", ",".join(spec.operations(t) or [])))]
    return spark.createDataFrame(rows, "task string, attribute string, value string")


@query(f"""WITH {PX}, w AS (SELECT row_idx - 2 AS row_idx, col_idx - 10 AS col_idx, scl FROM px WHERE row_idx BETWEEN 2 AND 9 AND col_idx BETWEEN 10 AND 49)
SELECT row_idx * 2 + i AS row_idx, col_idx * 2 + j AS col_idx, CAST(scl IN (3, 7, 8, 9, 10) AS INTEGER) AS scl FROM w, range(2) a(i), range(2) b(j)""")
def workflow_run(spark: SparkSession, d: str) -> DataFrame:
    """The document's operations, in order, as one plan."""
    return wf.pipeline_of(wf.WorkflowSpec(DOCUMENT), "mask_raster").run(bands(spark, d, "scl"))


@query(f"""WITH {PX}, f AS (SELECT row_idx, col_idx, red, nir, scl FROM px WHERE row_idx BETWEEN 2 AND 13 AND col_idx BETWEEN 10 AND 69), s AS (SELECT f.row_idx, f.col_idx, f.scl, f.red, f.nir, c.swir FROM f JOIN px c ON c.row_idx = f.row_idx // 2 AND c.col_idx = f.col_idx // 2),
m AS (SELECT row_idx - 2 AS row_idx, col_idx - 10 AS col_idx, {', '.join(f'CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 9999 ELSE {b} END AS {b}' for b in ('red', 'nir', 'swir'))} FROM s)
SELECT row_idx, col_idx, red, nir, swir, {'CAST(trunc(coalesce(CAST(nir - red AS FLOAT) / nullif(CAST(nir + red AS FLOAT), 0), CAST(0 AS FLOAT)) * CAST(1000 AS FLOAT)) AS BIGINT)'} AS ndvi,
{'CAST(trunc(coalesce(CAST(nir - swir AS FLOAT) / nullif(CAST(nir + swir AS FLOAT), 0), CAST(0 AS FLOAT)) * CAST(1000 AS FLOAT)) AS BIGINT)'} AS nbr FROM m""")
def workflow_stack_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Fine and coarse bands of a scene stacked, cut, masked and indexed as one plan."""
    mask = bands(spark, d, "scl").select("row_idx", "col_idx", r.mask_values("scl", r.CLOUD_CLASSES).alias("masked"))
    indexes = {"ndvi": ("ndvi", ["red", "nir"]), "nbr": ("nbr", ["nir", "swir"])}
    return wf.stack_scene(bands(spark, d, "red", "nir"), bands(spark, d, "swir"), mask, (10, 2, 60, 12), None, indexes)


def queries() -> dict:
    return reg.queries


def oracle_sql() -> dict:
    return reg.sql
