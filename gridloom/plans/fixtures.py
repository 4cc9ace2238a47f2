"""Rasters, points and catalogues derived from the general tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

BANDS = ["red", "blue", "green", "nir", "swir"]
#: Scene-band names that a synthetic catalogue takes in turn; B01 must be rejected.
NAMES = ["B02", "B03", "B04", "B05", "B08", "B8A", "B11", "B12", "SCL", "TCI", "B01", "AOT"]
UNIT = (1.0, -1.0, 0.0, 0.0)

PX = """px AS (SELECT o_orderkey // 100 AS row_idx, o_orderkey % 100 AS col_idx, cc % 4096 AS red, (cc // 7) % 4096 AS blue, (cc // 11) % 4096 AS green,
  (cc // 13) % 4096 AS nir, (cc // 17) % 4096 AS swir, o_custkey % 12 AS scl, o_orderkey
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cc FROM orders) o)"""
PAIRS = f"""{PX}, pairs AS (SELECT 1 AS band, row_idx, col_idx, red AS x, red + 40 + (o_orderkey % 7) * 60 AS y FROM px
  UNION ALL SELECT 2, row_idx, col_idx, nir, nir FROM px UNION ALL SELECT 3, row_idx, col_idx, swir, (swir * 3) // 2 + 25 FROM px)"""
FOOT = """foot AS (SELECT s_suppkey AS id, CAST((s_suppkey % 10) * 90 AS DOUBLE) AS "left", CAST((s_suppkey // 10) * 90 AS DOUBLE) AS bottom,
  CAST((s_suppkey % 10) * 90 + 100 AS DOUBLE) AS "right", CAST((s_suppkey // 10) * 90 + 100 AS DOUBLE) AS top FROM supplier)"""
POINTS = """pts AS (SELECT event_id AS point_id, value AS x, -(CAST(user_id AS DOUBLE) + 0.5) AS y, event_type AS classname,
  dense_rank() OVER (ORDER BY event_type) AS id FROM events)"""
S2 = """s2 AS (SELECT o_orderkey AS pos, concat('T', lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0'), 'MBN_', CAST(20170000 + o_orderkey % 1000 AS VARCHAR), 'T075211_',
  ['B02','B03','B04','B05','B08','B8A','B11','B12','SCL','TCI','B01','AOT'][CAST(o_orderkey % 12 AS INTEGER) + 1], CASE WHEN o_orderkey % 2 = 0 THEN '_10m' ELSE '_20m' END, '.jp2') AS fname FROM orders)"""
UDM = "udm AS (SELECT l_suppkey AS img, CASE WHEN l_quantity > 48 - (l_suppkey % 5) THEN 1 ELSE 0 END AS v FROM lineitem)"
PRED = "pred AS (SELECT vec_id, label AS truth, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS prediction FROM embeddings)"
SCENE = "'^(T[0-9]{2}[^0-9]{3})_([0-9]{8}).*_(B02|B03|B04|B05|B06|B07|B08|B8A|B09|B11|B12|AOT|SCL|TCI|WVP)([A-Za-z0-9_]*)'"


def px(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cc"))
    cut = lambda k: F.expr(f"(cc div {k}) % 4096")
    return o.select(
        F.expr("o_orderkey div 100").alias("row_idx"), (F.col("o_orderkey") % 100).alias("col_idx"), cut(1).alias("red"), cut(7).alias("blue"),
        cut(11).alias("green"), cut(13).alias("nir"), cut(17).alias("swir"), (F.col("o_custkey") % 12).alias("scl"), "o_orderkey",
    )


def bands(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return px(spark, d).select("row_idx", "col_idx", *names)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reference and target values of three bands, from one scan."""
    y1 = F.col("red") + 40 + (F.col("o_orderkey") % 7) * 60
    rows = [(1, F.col("red"), y1), (2, F.col("nir"), F.col("nir")), (3, F.col("swir"), F.expr("(swir * 3) div 2 + 25"))]
    every = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), x.alias("x"), y.alias("y")) for b, x, y in rows]))
    return px(spark, d).select("row_idx", "col_idx", every.alias("p")).select("p.band", "row_idx", "col_idx", "p.x", "p.y")


def footprints(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 * 90).cast("double").alias("left"), F.expr("cast((s_suppkey div 10) * 90 as double)").alias("bottom"))
    return s.withColumns({"right": F.col("left") + 100, "top": F.col("bottom") + 100})


def points(spark: SparkSession, d: str) -> DataFrame:
    """Event values as points; the class number is the rank of its name, taken from the few distinct names."""
    e = table(spark, d, "events")
    names = e.select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")).alias("names")).withColumn("one", F.lit(1))
    joined = e.select("event_id", "value", "user_id", "event_type").withColumn("one", F.lit(1)).join(F.broadcast(names), "one")  # one row
    return joined.select(
        F.col("event_id").alias("point_id"), F.col("value").alias("x"), (-(F.col("user_id").cast("double") + 0.5)).alias("y"), F.col("event_type").alias("classname"),
        F.array_position("names", F.col("event_type")).alias("id"),
    )


def scene_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    band = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    name = F.concat(F.lit("T"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit("MBN_"), (F.col("o_orderkey") % 1000 + 20170000).cast("string"), F.lit("T075211_"), band, F.when(F.col("o_orderkey") % 2 == 0, "_10m").otherwise("_20m"), F.lit(".jp2"))
    return o.select(F.col("o_orderkey").alias("pos"), name.alias("fname"))


def cloud_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("img"), F.when(F.col("l_quantity") > 48 - F.col("l_suppkey") % 5, 1).otherwise(0).alias("v"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth"), ((F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10).alias("prediction"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
