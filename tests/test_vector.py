"""Vector files, written and read again."""

import pytest

from gridloom.functions.geometry import parse_point, parse_polygon
from gridloom.sources import vector as vc
from pyspark.sql import functions as F

HOLED = "POLYGON ((0.0 0.0, 0.0 9.0, 9.0 9.0, 9.0 0.0, 0.0 0.0), (2.0 2.0, 4.0 2.0, 4.0 4.0, 2.0 4.0, 2.0 2.0))"
PIECES = "MULTIPOLYGON (((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 5.0 8.0, 8.0 8.0, 8.0 5.0, 5.0 5.0), (6.0 6.0, 7.0 6.0, 7.0 7.0, 6.0 6.0)))"


def same(a, b):
    turned = lambda ring: min(tuple(r[k:] + r[:k]) for r in (ring, ring[::-1]) for k in range(len(ring)))
    shape = lambda t: sorted([turned(p[0]), *sorted(map(turned, p[1:]))] for p in parse_polygon(t))
    return shape(a) == shape(b)


def test_shapefiles_of_points(spark, tmp_path):
    rows = [(i, f"POINT ({i}.5 {-i})", "name é" if i % 2 else None) for i in range(40)] + [(90, "POINT EMPTY", "x")]
    df = spark.createDataFrame(rows, "k long, g string, n string").repartition(3)
    vc.write_shapefile(df, str(tmp_path / "pts"), "g", ["k", "n"], "LOCAL_CS[]")
    back = vc.read_shapefile(spark, f"file://{tmp_path}/pts").collect()
    assert {(int(r.properties["k"]), parse_point(r.geometry), r.properties["n"]) for r in back} == {(k, parse_point(g), n) for k, g, n in rows}
    assert len({r.feature_id for r in back}) == len(rows) and len(list((tmp_path / "pts").glob("*.prj"))) == len(list((tmp_path / "pts").glob("*.shp"))) == 3


@pytest.mark.parametrize("records", [1, 200_000])
def test_shapefiles_of_regions(spark, tmp_path, records):
    df = spark.createDataFrame([(1, HOLED), (2, PIECES), (3, None)], "k long, g string").coalesce(1)
    vc.write_shapefile(df, str(tmp_path / "polys"), "g", ["k"])
    got = vc.read_shapefile(spark, str(tmp_path / "polys"), records)
    assert got.rdd.getNumPartitions() == (3 if records == 1 else 1)
    back = {int(r.properties["k"]): r.geometry for r in got.collect()}
    assert same(back[1], HOLED) and same(back[2], PIECES) and back[3] is None


def test_mixed_kinds_raise(spark, tmp_path):
    df = spark.createDataFrame([(HOLED,), ("POINT (1 2)",)], "g string").coalesce(1)
    with pytest.raises(Exception, match="points and regions"):
        vc.write_shapefile(df, str(tmp_path / "x"), "g", [])
    assert not list(tmp_path.glob("x/*"))


@pytest.mark.parametrize("lines", [True, False])
def test_geojson(spark, tmp_path, lines):
    df = spark.createDataFrame([(1, 2.5, -3.0, "a \"quoted\" name"), (2, 0.0, 1e20, None)], "k long, x double, y double, n string")
    df = df.withColumn("p", vc.point_json(F.col("x"), F.col("y"))).withColumn("b", vc.box_json(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1))
    path = str(tmp_path / "out")
    if lines:
        vc.write_geojson(df, path, "p", ["k", "n"])
    else:
        text = ",".join(r.value for r in vc.feature_lines(df, "p", ["k", "n"]).collect())
        (tmp_path / "out").write_text('{"type": "FeatureCollection",\n "features": [' + text + "]}")
    got = {int(r.properties["k"]): (parse_point(r.geometry), r.properties["n"]) for r in vc.read_geojson(spark, path, lines).collect()}
    assert got == {1: ((2.5, -3.0), "a \"quoted\" name"), 2: ((0.0, 1e20), None)}
    assert parse_polygon(df.first().b) == [[[(2.5, -3.0), (3.5, -3.0), (3.5, -2.0), (2.5, -2.0)]]]


def test_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert vc.read_shapefile(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.json").write_text("no features here")
    assert vc.read_geojson(spark, str(tmp_path / "a.json")).count() == 0 and vc.read_geojson(spark, str(tmp_path / "a.json"), True).count() == 0
