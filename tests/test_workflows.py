"""Errors and odd cases of the composed operators; their queries are compared with SQL in test_oracle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.names import output_name
from gridloom.operators import calibration as cal
from gridloom.operators import classify as cl
from gridloom.operators import display as dp
from gridloom.operators import overlap as ov
from gridloom.operators import raster as r
from gridloom.operators import sampling as sp
from gridloom.plans import workflow as wf
from gridloom.plans import workflows as ws
from gridloom.sources import catalog as ct
from gridloom.sources import documents as doc
from gridloom.sources import geotiff as gt

BOX = [(2.0, -6.0), (5.0, -6.0), (5.0, -2.0), (2.0, -2.0)]
GRID = {"a": 1.0, "e": -1.0, "c": 0.0, "f": 0.0, "width": 10, "height": 8}


def grid(spark, rows=8, cols=10, value=lambda i, j: float(i * 10 + j)):
    return spark.createDataFrame([(i, j, value(i, j)) for i in range(rows) for j in range(cols)], "row_idx long, col_idx long, v double")


def test_clip_raster(spark):
    pixels, window = r.clip_raster(grid(spark), GRID, BOX)
    assert window == (2, 2, 3, 4) and sorted((p.row_idx, p.col_idx) for p in pixels.collect()) == [(i, j) for i in range(4) for j in range(3)]
    for region in ([(20.0, -6.0), (25.0, -6.0), (25.0, -2.0)], "POLYGON ((100 100, 101 100, 101 101, 100 100))"):
        with pytest.raises(ValueError, match="overlap"):
            r.clip_raster(grid(spark), GRID, region)
    with pytest.raises(ValueError, match="readable"):
        r.clip(grid(spark), "POLYGON EMPTY", (1.0, -1.0, 0.0, 0.0))


def test_many_edges_like_few(spark, monkeypatch):
    from gridloom.functions import numeric

    angles = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    ring = [(float(5 + 4.1 * np.cos(a)), float(-4 + 3.1 * np.sin(a))) for a in angles]
    few = sorted(map(tuple, r.clip(grid(spark), ring, (1.0, -1.0, 0.0, 0.0)).collect()))
    monkeypatch.setattr(numeric, "PLAIN_EDGES", 5)
    assert few == sorted(map(tuple, r.clip(grid(spark), ring, (1.0, -1.0, 0.0, 0.0)).collect())) and few


@pytest.mark.parametrize("method", [*r.KERNELS, *r.STATISTICS, "nearest"])
def test_a_constant_raster_stays_constant(spark, method):
    flat = grid(spark, value=lambda i, j: 7.0)
    got = r.resample(flat, ["v"], 0.5, method, 8, 10).collect()
    assert {(p.row_idx, p.col_idx) for p in got} == {(i, j) for i in range(4) for j in range(5)}
    assert {round(p.v, 9) for p in got} == {28.0 if method == "sum" else 7.0}


def test_resampling_errors(spark):
    for options, told in (((0.3, "mode"), "integer"), ((2, "cubic"), "height"), ((2, "other"), "unknown")):
        with pytest.raises(ValueError, match=told):
            r.resample(grid(spark), ["v"], *options)


def test_nulls_do_not_weigh(spark):
    holes = grid(spark, value=lambda i, j: None if (i, j) == (3, 3) else 4.0)
    for method in ("cubic", "lanczos", "average", "mode"):
        assert {round(p.v, 9) for p in r.resample(holes, ["v"], 0.5, method, 8, 10).collect()} == {4.0}


def test_infinities_are_the_largest_numbers(spark):
    pairs = spark.createDataFrame([(1, 0.0, 0.0), (1, float("inf"), float("nan")), (1, None, 4.0), (1, float("-inf"), 2.0)], "band int, x double, y double")
    got = {(None if p.x is None else p.x): p for p in cal.minmax_difference(pairs).collect()}
    assert got[cal._LARGEST].y == 0.0 and -cal._LARGEST in got and got[None].nx is None


def test_corrected_values_are_of_sixteen_bits(spark):
    df = spark.createDataFrame([(70_000.0, 10.5), (5.0, 10.0), (5.0, 2.5)], "v double, b double")
    assert [x[0] for x in df.select(cal.corrected(F.col("v"), F.col("b"))).collect()] == [70_000 - 11 - 65_536, 5, 2]


def test_mosaic_of_nothing_and_of_mixed_bands(spark):
    pixels = spark.createDataFrame([("a", 1, 0, 0, 5.0), ("a", 2, 0, 0, 6.0), ("b", 1, 0, 0, 7.0), ("b", 3, 0, 0, 9.0), ("a", 1, 0, 1, None)], "raster_id string, band int, row_idx long, col_idx long, value double")
    grids = spark.createDataFrame([("a", 0, 1.0, -1.0, 0.0, 0.0, 2, 1, 0.0, 2), ("b", 1, 1.0, -1.0, 0.4, 0.0, 2, 1, None, 3)], "raster_id string, src_pos int, a double, e double, c double, f double, width int, height int, nodata double, band_count int")
    cells, made = r.mosaic_rasters(pixels, grids)
    assert (made["width"], made["height"], made["band_count"]) == (3, 1, 2)
    assert {(p.band, p.col_idx): p.value for p in cells.collect()} == {(1, 0): 7.0, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 6.0, (2, 1): 0.0, (2, 2): 0.0}
    with pytest.raises(ValueError, match="no rasters"):
        r.mosaic_rasters(pixels, grids.limit(0))


def test_split_is_exact_for_every_label(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(997)]
    split = sp.stratified_split(spark.createDataFrame(rows, "k long, label int").repartition(5), "k", "label", 0.3)
    got = {x.label: (x.n, x.t) for x in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == int(np.ceil(0.3 * n)) for n, t in got.values()) and sum(n for n, _ in got.values()) == 997
    again = sp.stratified_split(spark.createDataFrame(rows[::-1], "k long, label int"), "k", "label", 0.3)
    assert {x.k for x in again.filter("is_test").collect()} == {x.k for x in split.filter("is_test").collect()}
    assert sp.stratified_split(split.drop("is_test").limit(0), "k", "label", 0.3).count() == 0


def test_numbers_over_many_partitions(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k long, n string").repartition(9)
    assert sorted((x.k, x.number) for x in ov.number_rows(df, "k", "number").collect()) == [(i, i + 1) for i in range(101)]


def test_labels(spark):
    labels = spark.createDataFrame([("a", " 1"), ("b", "2.0"), (None, "3")], "classname string, id string")
    samples = spark.createDataFrame([([1.0], 1), ([2.0], 2), ([3.0], None)], "features array<double>, label int")
    made, named = sp.add_named_class(samples, labels, "masked", 1, 9999.0)
    assert sp.label_of(named, "masked") == 3 and made.filter("label = 3").count() == 1
    less, fewer = sp.remove_named_class(made, named, "b")
    assert {x.label for x in less.collect()} == {1, 3, None} and {x.classname for x in fewer.collect()} == {"a", "masked", None}
    with pytest.raises(KeyError):
        sp.remove_named_class(made, labels, "none")
    nothing, same = sp.add_named_class(samples.limit(0), labels, "masked", 1, 9999.0)
    assert nothing.count() == 0 and same.count() == 3


def test_catalogue_lookups(spark):
    rows = [("T37MBN_20170718_B02_10m.tif", "/a/R10m/1"), ("T37MBN_20170718_B02_10m.tif", "/a/R10m/2"), ("T37MBN_20170719_B05_20m.tif", "/a/R20m/1")]
    files = ct.scene_catalog(spark.createDataFrame(rows, "fname string, fpath string"))
    assert ct.path_of(files, "B02_10m") == "/a/R10m/2" and ct.attribute_of(files, "B05_20m", "date") == "20170719" and ct.attribute_of(files, "B99", "date") is None
    with pytest.raises(KeyError):
        ct.path_of(files, "B99")
    fine, coarse = (files.filter(F.col("fpath").contains(k)) for k in ("R10m", "R20m"))
    assert ct.band_paths(fine, coarse, ["B05_20m", "B02_10m"]) == [("B05_20m", "/a/R20m/1", False), ("B02_10m", "/a/R10m/2", True)]
    with pytest.raises(ValueError, match="B99"):
        ct.band_paths(fine, coarse, ["B02_10m", "B99"])


def test_output_names(spark):
    with pytest.raises(ValueError, match="unknown"):
        output_name("other")
    with pytest.raises(ValueError, match="date"):
        output_name("stack", tile=F.lit("T"))


def test_class_plots(spark):
    with pytest.raises(ValueError, match="unknown classes"):
        dp.class_colours({"a": (0, (1, 2, 3))}, ["b"])
    chained = {"a": (2, (255, 0, 0)), "b": (1, (0, 255, 0))}
    got = dp.class_plot(spark.createDataFrame([(1,), (2,), (9,)], "v int"), "v", {"a": 1, "b": 2}, chained, ["a", "b"]).collect()
    assert [(p["index"], p.colour) for p in got] == [(1, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0]), (9, [1.0, 1.0, 1.0])]


class Sum:
    def predict(self, matrix):
        return matrix.sum(axis=1)


def test_foreign_classifier(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, None, "y"), (3, [float("nan"), None], None)], "k long, features array<double>, _features string")
    df = df.withColumnRenamed("_features", "own")
    assert sorted((p.k, p.prediction, p.own) for p in cl.predict_batches(df, ws.Larger()).collect()) == [(1, 1, "x"), (2, None, "y"), (3, 0, None)]
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k long, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        cl.predict_batches(ragged, ws.Larger()).collect()
    assert cl.predict_batches(df.limit(0), ws.Larger()).count() == 0
    monkeypatch.setattr(cl, "MODEL_BYTES", 1)
    with pytest.raises(ValueError, match="bytes"):
        cl.predict_batches(df, ws.Larger())


def test_repeated_runs_and_reports(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 3), 1, 2)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, features array<double>, label int")
    seen = []
    got = cl.repeated_runs(df, "k", 3, trees=5, depth=4, then=lambda run, model: seen.append((run, model.getNumTrees)))
    assert sorted((x.run, x.part) for x in got.collect()) == [(i, p) for i in (1, 2, 3) for p in ("test", "train")] and sorted(seen) == [(1, 5), (2, 5), (3, 5)]
    report = cl.full_report(cl.train_and_predict(df, "k", trees=5, depth=4)[1], without=1).collect()
    assert {x.metric for x in report} == {"confusion", "accuracy", "kappa", "commission", "omission", "user", "producer"} and {x.truth for x in report} == {0, 1, None}
    test = [x for x in report if x.part == "test"]
    hits, total = sum(x.value for x in test if x.metric == "confusion" and x.truth == x.prediction), sum(x.value for x in test if x.metric == "confusion")
    assert next(x.value for x in test if x.metric == "accuracy") == pytest.approx(hits / total, abs=1e-8)


def test_lines_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 100, f"line {i * 37 % 100:03d}") for i in range(100)], "k long, line string").repartition(6)
    doc.write_lines(df, "line", ["k"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == [f"line {k:03d}" for k in range(100)]


def test_documents_of_bounded_size(spark):
    samples = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(25)], "k long, features array<double>, label int")
    labels = spark.createDataFrame([("a", "0"), ("b", "1")], "classname string, id string")
    docs = doc.training_documents(samples, "k", labels, 10)
    assert sorted(x.number for x in docs.collect()) == [0, 1, 2]
    back = doc.training_rows(docs).collect()
    assert sorted(x.features[0] for x in back) == [float(i) for i in range(25)] and max(x.pos for x in back) == 9
    assert {tuple(x) for x in doc.training_labels(docs).collect()} == {("a", "0"), ("b", "1")}


def test_scene_errors(spark, tmp_path):
    for place, size in (("R10m", 10.0), ("R20m", 20.0)):
        (tmp_path / place).mkdir()
        name = f"T37MBN_20170718T075211_{'B02' if size == 10 else 'B05'}_{int(size)}m.tif"
        gt.write_geotiff(str(tmp_path / place / name), np.arange(1, 37, dtype="uint16").reshape(1, 6, 6), size, -size, 0.0, 0.0, crs="EPSG:32737")
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="not both"):
        wf.stack_of_scene(spark, folder, ["B02_10m"], area=(0, 0, 1, 1), region=BOX)
    with pytest.raises(ValueError, match="B99"):
        wf.stack_of_scene(spark, folder, ["B99_10m"])
    with pytest.raises(ValueError, match="same system, size"):
        wf.stack_of_scene(spark, folder, ["B02_10m", "B05_20m"])
    with pytest.raises(ValueError, match="overlap"):
        wf.stack_of_scene(spark, folder, ["B02_10m"], region=[(500.0, 0.0), (600.0, 0.0), (600.0, -50.0)])
    pixels, grid = wf.stack_of_scene(spark, folder, ["B02_10m", "B05_20m"], area=(1, 1, 4, 4))
    assert (grid["c"], grid["f"], grid["width"]) == (10.0, -10.0, 4)
    got = {(p.row_idx, p.col_idx): (p["B02_10m"], p["B05_20m"]) for p in pixels.collect()}
    assert len(got) == 16 and got[0, 0] == (8.0, 1.0) and got[3, 3] == (29.0, 15.0)
    assert wf.scene_name(spark, folder) == "T37MBN_20170718.tif"
    (tmp_path / "none" / "R10m").mkdir(parents=True)
    (tmp_path / "none" / "R20m").mkdir()
    with pytest.raises(ValueError, match="no file name fits"):
        wf.scene_catalogs(spark, str(tmp_path / "none"))


def test_points_outside_cover(spark):
    points = spark.createDataFrame([(1, 0.5, -0.5), (2, 1.5, -0.5), (3, 2.0, -0.5), (4, 50.0, -0.5), (5, 3.5, -0.5)], "point_id long, x double, y double")
    pixels = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.9), (0, 2, 0.1), (0, 3, 0.0)], "row_idx long, col_idx long, v double")
    seen = sp.outside_cover(points, pixels, F.col("v"), (1.0, -1.0, 0.0, 0.0), 2, 0.3)
    assert {x.point_id: x.taken for x in seen.collect()} == {1: True, 2: False, 5: False}  # the third lies on a block's border
    assert tuple(sp.cover_counts(points, seen).first()) == (5, 3, 1, 2, 1)
