"""Queries on points near points and in regions (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import total_bounds
from gridloom.operators.proximity import inside_regions, near_pairs, read_points, triangles_of
from gridloom.session import cut, table

#: Metres.
NEAR = 25.0


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read_points(table(spark, d, "gdf_points"), "point_id", "geometry")


def _near(points: DataFrame) -> DataFrame:
    return near_pairs(points, NEAR)


def _inside(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    found = inside_regions(points, triangles_of(table(spark, d, "overlap_polys"), "poly_id", "geometry"))
    return found.select(F.col("id").alias("point_id"), F.col("poly").alias("poly_id"))


def p5_near(spark: SparkSession, d: str) -> DataFrame:
    return _near(cut(_points(spark, d), "points"))


def p5_inside(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d, _points(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Both relations, over points that are parsed once."""
    points = cut(_points(spark, d), "points")
    near = _near(points).select(F.lit("near").alias("relation"), "first_id", "second_id")
    inside = _inside(spark, d, points).select(F.lit("inside").alias("relation"), F.col("point_id").alias("first_id"), F.col("poly_id").alias("second_id"))
    return near.unionByName(inside)


def points_aoi(spark: SparkSession, d: str) -> DataFrame:
    """The box around all readable points."""
    return total_bounds(read_points(table(spark, d, "gdf_points"), "point_id", "geometry"))


_NUM = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_READ = rf"""
pts AS (SELECT DISTINCT point_id AS id, x, y FROM (
  SELECT point_id,
    try_cast(CASE WHEN contains(geometry, '{{') THEN regexp_extract(geometry, '"coordinates"\s*:\s*\[\s*({_NUM})\s*,\s*({_NUM})', 1)
      ELSE regexp_extract(geometry, '(?i)POINT\s*Z?\s*\(\s*({_NUM})\s+({_NUM})', 1) END AS DOUBLE) AS x,
    try_cast(CASE WHEN contains(geometry, '{{') THEN regexp_extract(geometry, '"coordinates"\s*:\s*\[\s*({_NUM})\s*,\s*({_NUM})', 2)
      ELSE regexp_extract(geometry, '(?i)POINT\s*Z?\s*\(\s*({_NUM})\s+({_NUM})', 2) END AS DOUBLE) AS y
  FROM gdf_points) t WHERE point_id IS NOT NULL AND isfinite(x) AND isfinite(y))"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_near": p5_near, "p5_inside": p5_inside, "points_aoi": points_aoi}


#: Rings of both notations as lists of numbers, then edges; inside by the parity of crossed edges.
_REGIONS = rf"""
txt AS (SELECT poly_id, geometry AS g FROM overlap_polys WHERE poly_id IS NOT NULL AND geometry IS NOT NULL),
rings AS (SELECT poly_id, unnest(CASE WHEN contains(g, '{{') THEN regexp_extract_all(g, '\[(\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*)\]', 1) ELSE regexp_extract_all(g, '\(([-0-9][^()]*)\)', 1) END) AS r,
  generate_subscripts(CASE WHEN contains(g, '{{') THEN regexp_extract_all(g, '\[(\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*)\]', 1) ELSE regexp_extract_all(g, '\(([-0-9][^()]*)\)', 1) END, 1) AS ring FROM txt),
nums AS (SELECT poly_id, ring, regexp_extract_all(r, '{_NUM}') AS n FROM rings),
vert AS (SELECT poly_id, ring, i, CAST(n[2 * i - 1] AS DOUBLE) AS x, CAST(n[2 * i] AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, len(n) // 2 + 1)) AS i FROM nums) v),
edge AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vert WINDOW w AS (PARTITION BY poly_id, ring ORDER BY i)),
box AS (SELECT poly_id, min(x) AS l, min(y) AS b, max(x) AS r, max(y) AS t FROM vert GROUP BY 1),
near_box AS (SELECT id, p.x, p.y, poly_id FROM pts p JOIN box ON p.x BETWEEN l AND r AND p.y BETWEEN b AND t),
ins AS (SELECT id, poly_id FROM near_box JOIN edge USING (poly_id) WHERE x2 IS NOT NULL AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def oracle_sql() -> dict:
    pairs = """c AS (SELECT *, CAST(floor(x / 25) AS BIGINT) AS cx, CAST(floor(y / 25) AS BIGINT) AS cy FROM pts),
n AS (SELECT id, x, y, cx + dx AS cx, cy + dy AS cy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
near AS (SELECT DISTINCT a.id AS first_id, b.id AS second_id FROM n a JOIN c b ON a.cx = b.cx AND a.cy = b.cy
WHERE a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625)"""
    return {
        "p5_near": f"WITH {_READ}, {pairs} SELECT first_id, second_id FROM near",
        "p5_inside": f"WITH {_READ}, {_REGIONS} SELECT id AS point_id, poly_id FROM ins",
        "p5_found": f"WITH {_READ}, {pairs}, {_REGIONS} SELECT 'near' AS relation, first_id, second_id FROM near UNION ALL SELECT 'inside', id, poly_id FROM ins",
        "points_aoi": f"WITH {_READ} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts",
    }
