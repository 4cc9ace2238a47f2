"""Hand-computed grids and edge cases of the raster operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import names as nm
from gridloom.functions import numeric as nu
from gridloom.operators import calibration as cal
from gridloom.operators import classify as cl
from gridloom.operators import grid as g
from gridloom.operators import overlap as ov
from gridloom.operators import raster as r
from gridloom.operators import sampling as sp
from gridloom.operators.display import histogram, recode, stretch_8bit, unit_colours
from gridloom.plans import workflow as wf
from gridloom.sources import catalog as ct
from gridloom.sources import documents as doc
from gridloom.sources import tiles

CELLS = "row_idx bigint, col_idx bigint"


def grid_of(spark, values, name="v", kind="double"):
    rows = [(i, j, v) for i, line in enumerate(values) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, f"{CELLS}, {name} {kind}")


def as_dict(df, *columns):
    return {(x["row_idx"], x["col_idx"]): tuple(x[c] for c in columns) if len(columns) > 1 else x[columns[0]] for x in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "dtype", "want"), [(-100.7, "uint16", 65436), (65536.0, "uint16", 0), (-1.0, "uint8", 255), (200.0, "int8", -56), (float("nan"), "uint16", 0), (3.9, "int64", 3)])
def test_wrap_cast(spark, value, dtype, want):
    assert one(spark, nu.wrap_cast(F.lit(value), dtype)) == want


def test_wrap_cast_unknown():
    with pytest.raises(ValueError):
        nu.wrap_cast(None, "complex64")


def test_index_zero_denominator_and_null(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (None, 3), (3, 1)], "red int, nir int")
    got = [x["v"] for x in df.select(nu.index_column("ndvi", [F.col("red"), F.col("nir")]).alias("v")).collect()]
    assert got == [0, 500, None, -500]
    with pytest.raises(ValueError):
        nu.index_column("evi", [])
    with pytest.raises(ValueError):
        nu.scaled(F.lit(1.0), 10)


def test_finite_or_zero(spark):
    values = [float("nan"), float("inf"), float("-inf"), 2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [x["v"] for x in df.select(nu.finite_or_zero(F.col("v")).alias("v")).collect()] == [0.0, 0.0, 0.0, 2.5, None]


def test_masks(spark):
    p = grid_of(spark, [[3, 1], [None, 9]], kind="int")
    masked = as_dict(p.withColumn("m", r.mask_values("v", [3, 9])), "m")
    assert masked == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): True}
    assert as_dict(r.apply_mask(p, ["v"], r.mask_values("v", [3, 9])), "v") == {(0, 0): 0, (0, 1): 1, (1, 0): None, (1, 1): 0}
    assert as_dict(r.masked_read(p, ["v"], 9), "v")[1, 1] is None
    assert r.masked_read(p, ["v"], None) is p


def test_window_and_selection(spark):
    p = grid_of(spark, np.arange(16.0).reshape(4, 4).tolist())
    assert as_dict(r.window(p, 1, 2, 2, 1), "v") == {(0, 0): 9.0, (0, 1): 10.0}
    assert r.window(p, 10, 10, 2, 2).count() == 0
    with pytest.raises(ValueError):
        r.select_bands(p, ["v"], [2])


def test_window_is_pushed_to_the_scan(spark, small):
    from gridloom.session import table

    docs = table(spark, small, "gdf_points").select(F.col("point_id").alias("row_idx"), F.col("point_id").alias("col_idx"), "tile_n")
    plan = r.window(docs, 0, 5, 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(point_id)" in plan
    assert "geometry" not in plan


def test_resample_round_trip(spark):
    p = grid_of(spark, np.arange(12.0).reshape(3, 4).tolist())
    up = r.resample_nearest(p, 2)
    assert up.count() == 48
    assert as_dict(r.resample_nearest(up, 0.5), "v") == as_dict(p, "v")
    down = as_dict(r.resample_nearest(grid_of(spark, np.arange(16.0).reshape(4, 4).tolist()), 0.5), "v")
    assert down == {(0, 0): 5.0, (0, 1): 7.0, (1, 0): 13.0, (1, 1): 15.0}
    third = as_dict(r.resample_nearest(p, 1.5), "v")
    assert third == {(i, j): p_ for i in range(4) for j in range(6) for p_ in [math.floor((i + 0.5) / 1.5) * 4 + math.floor((j + 0.5) / 1.5)]}
    assert as_dict(r.resample_average(p, ["v"], 2), "v") == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 8.5, (1, 1): 10.5}


def test_mosaic(spark):
    layers = spark.createDataFrame(
        [(0, 1, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, 2.0), (1, 1, 1.0, 0.0, 0.0), (1, 1, 2.0, 0.0, 5.0), (2, 1, 0.0, -1.0, None)],
        "src_pos int, band int, x double, y double, value double",
    ).withColumns({"res": F.lit(1.0), "north": F.lit(0.0), "west": F.lit(0.0)})
    got = as_dict(r.mosaic(layers, 0.0), "value")
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 5.0}
    filled = as_dict(r.fill_grid(r.mosaic(layers, 0.0), 1, 2, 3), "value")
    assert filled[1, 0] == 0.0 and len(filled) == 6


def test_stack_and_compatibility(spark):
    p = grid_of(spark, [[1.0, 2.0]]).withColumn("w", F.col("v") * 10)
    assert as_dict(r.stack(r.unstack(p, ["w", "v"]), [1, 2]), "b1", "b2") == {(0, 0): (10.0, 1.0), (0, 1): (20.0, 2.0)}
    grids = spark.createDataFrame([("epsg: 3857", 2, 2, 1.0, -1.0), ("EPSG:3857", 2, 2, 1.0, -1.0)], "crs string, width int, height int, a double, e double")
    assert tuple(r.compatible(grids).first()) == (True, True, True)
    assert tuple(r.compatible(grids.withColumn("a", F.monotonically_increasing_id().cast("double"))).first()) == (True, True, False)
    with pytest.raises(ValueError):
        r.add_indexes(p, {"n": ("ndvi", ["red", "v"])})


def test_clip(spark):
    p = grid_of(spark, np.zeros((6, 6)).tolist())
    box = as_dict(r.clip_box(p, (1.0, -4.0, 3.0, -2.0), (1.0, -1.0, 0.0, 0.0)), "v")
    assert set(box) == {(2, 1), (2, 2), (3, 1), (3, 2)}
    ring = [(0.0, 0.0), (6.0, 0.0), (0.0, -6.0)]
    assert set(as_dict(r.clip(p, ring, (1.0, -1.0, 0.0, 0.0)), "v")) == {(i, j) for i in range(6) for j in range(6) if i + j < 5}
    assert r.clip(p, [(50.0, -50.0), (51.0, -50.0), (51.0, -51.0)], (1.0, -1.0, 0.0, 0.0)).count() == 0


def test_blocks_and_bounds(spark):
    grids = spark.createDataFrame([("a", 10.0, -10.0, 100.0, 500.0, 5, 3)], "raster_id string, a double, e double, c double, f double, width int, height int")
    blocks = {(b.tile_row, b.tile_col): (b.row_off, b.col_off, b.height, b.width) for b in g.block_windows(grids, 2).collect()}
    assert blocks[1, 2] == (2, 4, 1, 1) and len(blocks) == 6
    b = g.with_bounds(grids).first()
    assert (b.left, b.bottom, b.right, b.top) == (100.0, 470.0, 150.0, 500.0)
    w = g.window_grid(grids, 1, 1, 2, 2).first()
    assert (w.c, w.f, w.width) == (110.0, 490.0, 2)
    up = g.resampled_grid(grids, 2).first()
    assert (up.a, up.width, up.height) == (5.0, 10, 6)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, left double, bottom double, right double, top double")


def test_overlaps(spark):
    df = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, 5.0, 5.0, 6.0, 6.0), (4, 100.0, 100.0, 110.0, 110.0), (5, None, 0.0, 1.0, 1.0), (6, 5.0, 5.0, 6.0, 6.0)])
    got = {(x.a_id, x.b_id) for x in ov.box_pairs(df, df, 7.0).filter("a_id < b_id").collect()}
    assert got == {(1, 2), (1, 3), (1, 6), (3, 6)}
    numbered = ov.pairwise_overlaps(df, 7.0).orderBy("poly_id").collect()
    assert [tuple(x) for x in numbered] == [(1, 10.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 6.0, 6.0)]
    assert {x.id for x in ov.reference_overlaps(df, 1, 7.0).collect()} == {2, 3, 6}
    assert one(spark, g.strictly_within(F.lit(0.0), F.lit(0.5), 0.0, 0.0, 1.0, 1.0)) is False


def test_overlaps_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(np.c_[rng.uniform(-50, 50, (60, 2)), rng.uniform(0, 30, (60, 2))])]
    got = {(x.a_id, x.b_id) for x in ov.box_pairs(boxes(spark, rows), boxes(spark, rows), 9.0).filter("a_id < b_id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert got == want


def test_calibration(spark):
    rows = [(1, float(x), 2.0 * x + 5) for x in range(10)] + [(2, 4.0, 4.0)] * 3
    pairs = spark.createDataFrame(rows, "band int, x double, y double")
    models = {m.band: m for m in cal.band_models(pairs).collect()}
    assert abs(models[1].slope - 2) < 1e-9 and abs(models[1].intercept - 5) < 1e-9 and models[1].mean_diff == 0
    assert models[2].slope is None and models[2].mean_diff is None
    assert cal.bands_correlation(pairs).count() == 0
    fit = {(c.band, c.power): c.coefficient for c in cal.polynomial_fit(pairs.filter("band = 1").withColumn("y", F.col("x") ** 2 - 3 * F.col("x") + 1), 2).collect()}
    assert np.allclose([fit[1, k] for k in range(3)], [1, -3, 1], atol=1e-8)
    assert one(spark, cal.line(F.lit(2.0), F.lit(3.0), F.lit(1.0))) == 5.0
    assert [one(spark, cal.corrected(F.lit(v), F.lit(100.5))) for v in (100, 101, 300)] == [100, 0, 199]


def test_sampling(spark):
    s = spark.createDataFrame([(i, [float(i)] * 2, i % 3 if i < 9 else None) for i in range(12)], "k long, features array<double>, label int")
    more = sp.add_class(s, 2, 9.0)
    assert more.filter("label = 3").count() == 3
    assert sp.remove_class(s, 1).count() == 9
    split = sp.stratified_split(s, "k", "label", 0.3).groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {x.label: x.n for x in split} == {0: 1, 1: 1, 2: 1, None: 1}
    assert [x.chunk for x in sp.chunks(s, "k", 5).orderBy("k").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    pts = spark.createDataFrame([(1, 0.5, -0.5, 7), (2, 5.0, -0.5, 7), (3, 1.2, -0.2, None)], "point_id long, x double, y double, id int")
    pix = spark.createDataFrame([(0, 0, 9999, 9999), (0, 1, 9999, 5)], f"{CELLS}, a int, b int")
    got = sp.extract(pts, pix, ["a", "b"], (1.0, -1.0, 0.0, 0.0)).collect()
    assert [(x.point_id, x.features, x.label) for x in got] == [(3, [9999.0, 5.0], None)]
    grouped = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "v int, grp int")
    assert {(x.a, x.b) for x in sp.front_pairs(grouped, "v").collect()} == {(1, 2), (1, 3), (2, 3)}


def test_empty_samples(spark):
    s = spark.createDataFrame([], "k long, features array<double>, label int")
    assert sp.add_class(s, 2, 1.0).count() == 0
    assert sp.stratified_split(s, "k", "label", 0.3).count() == 0
    assert cl.accuracy_kappa(spark.createDataFrame([], "truth int, prediction int")).first()["kappa"] is None


def test_accuracy(spark):
    diagonal = spark.createDataFrame([(i % 4, i % 4) for i in range(20)], "truth int, prediction int")
    assert tuple(cl.accuracy_kappa(diagonal).first()) == (1.0, 1.0)
    chance = spark.createDataFrame([(a, b) for a in range(2) for b in range(2) for _ in range(5)], "truth int, prediction int")
    assert tuple(cl.accuracy_kappa(chance).first()) == (0.5, 0.0)
    assert cl.dense_confusion(spark.createDataFrame([(0, 1)], "truth int, prediction int")).count() == 4
    errors = {e.label: e for e in cl.class_errors(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "truth int, prediction int")).collect()}
    assert (errors[0].user, errors[0].commission, errors[0].producer) == (0.5, 0.5, 1.0)


def test_forest_learns(spark):
    rows = [(i, [float(i % 2), float(i % 5)], i % 2) for i in range(60)]
    s = spark.createDataFrame(rows, "k long, features array<double>, label int")
    model = cl.train_forest(s, trees=5, depth=3)
    assert cl.predict(s, model).filter("prediction <> label").count() == 0


def test_display(spark):
    p = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    assert {h.bin: h.n for h in histogram(p, "v", 5).collect()} == {0: 2, 4: 1}
    assert {h.bin: h.n for h in histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").collect()} == {0: 3}
    assert sorted(x.v for x in stretch_8bit(p.filter("v is not null"), ["v"]).collect()) == [0, 25, 255]
    assert one(spark, recode(F.lit(1), [(1, 2), (2, 7)])) == 7
    assert one(spark, unit_colours(F.array(F.lit(255), F.lit(0)))) == [1.0, 0.0]


def test_names(spark):
    names = ["T37MBN_20170718T075211_B02.jp2", "T37MBN_20170718T075211_B8A_20m.jp2.aux.xml", "T37MBN_20170718T075211_B01.jp2", "x_T37MBN_20170718_B02.jp2", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "fname string")
    got = ct.scene_catalog(df).select("tile_n", "date", "band", "attr", "key").collect()
    assert [tuple(x) for x in got] == [("T37MBN", "20170718", "B02", "", "B02"), ("T37MBN", "20170718", "B8A", "_20m", "B8A_20m")]
    assert one(spark, nm.size_text(F.lit(1536))) == "1.5KiB"
    assert one(spark, nm.size_text(F.lit(12))) == "12.0B"
    assert one(spark, nm.digits(F.lit("poly_12_T3"))) == 123 and one(spark, nm.digits(F.lit("none"))) is None
    assert one(spark, nm.stem(F.lit("/a/b/c.tar.gz"))) == "c.tar" and one(spark, nm.dirname(F.lit("/a/b/c"))) == "/a/b"
    fields = nm.asset_fields(F.lit("20200714_103348_ssc6_u0001_ortho_panchromatic.tif"))
    assert (one(spark, fields["asset"]), one(spark, fields["info"])) == ("ortho_panchromatic", "20200714_103348_ssc6_u0001")
    assert one(spark, nm.asset_fields(F.lit("a_b"))["asset"]) is None


def test_cloud_cover_special_cases(spark):
    rows = [("zero", 0)] * 3 + [("one", 1)] * 3 + [("mixed", 0)] * 3 + [("mixed", 1)] + [("three", v) for v in (0, 1, 2)]
    got = {x.img: x.cloud_pct for x in ct.cloud_cover(spark.createDataFrame(rows, "img string, v int"), "img", "v").collect()}
    assert got == {"zero": 0.1, "one": None, "mixed": 25.0, "three": None}


def test_listing(spark, tmp_path):
    for name in ("T37MBN_20170718T075211_B02.jp2", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [x.fname for x in ct.list_files(spark, str(tmp_path), "*.jp2").collect()] == ["T37MBN_20170718T075211_B02.jp2"]


def test_documents(spark, tmp_path):
    s = spark.createDataFrame([(2, [1.5, 2.0], 7), (1, [0.0, -1.0], 8)], "k long, features array<double>, label int")
    labels = spark.createDataFrame([('say "kiln"', "7"), ("b\\c", "8")], "classname string, id string")
    made = doc.training_document(s, "k", labels)
    text = made.first()["document"]
    assert json.loads(json.loads(text)) == {"X": [[0.0, -1.0], [1.5, 2.0]], "y": [8, 7], "labels_map": {'say "kiln"': "7", "b\\c": "8"}}
    assert [tuple(x) for x in doc.training_rows(made).collect()] == [(0, [0.0, -1.0], 8), (1, [1.5, 2.0], 7)]
    doc.write_text(made, "document", str(tmp_path / "t"))
    assert doc.training_rows(doc.read_documents(spark, str(tmp_path / "t"))).count() == 2


def test_tiles(spark, tmp_path):
    p = grid_of(spark, np.arange(15.0).reshape(3, 5).tolist(), "value").withColumn("band", F.lit(1))
    back = tiles.from_tiles(tiles.to_tiles(p, 2), 2)
    assert as_dict(back, "value") == as_dict(p, "value")
    tiles.write_pixels(p.withColumn("raster_id", F.lit("a")), str(tmp_path / "px"))
    assert as_dict(tiles.read_pixels(spark, str(tmp_path / "px")), "value") == as_dict(p, "value")


def test_workflow(spark):
    good = {"ndvi": {"inp": "a", "out": "b", "operations": {"resample": {"scale": 2}}}}
    spec = wf.WorkflowSpec(good)
    assert spec.tasks() == ["ndvi"] and spec.operations("ndvi") == ["resample"] and spec.operation("ndvi", "none") is None
    assert wf.WorkflowSpec({}).tasks() == []
    for bad in ({"evi": {"inp": "a"}}, {"ndvi": {"input": "a"}}, {"ndvi": {"inp": "a"}, "evi": {"inp": "a"}}):
        with pytest.raises(ValueError):
            wf.WorkflowSpec(bad)
    assert wf.WorkflowSpec({"ndvi": {"inp": "a"}, "evi": {"inp": "a"}}, strict=False).tasks() == ["ndvi", "evi"]
    assert wf.pipeline_of(spec, "ndvi").run(grid_of(spark, [[1.0]])).count() == 4
    with pytest.raises(ValueError):
        wf.pipeline_of(wf.WorkflowSpec({"ndvi": {"operations": {"blur": {}}}}), "ndvi")
    with pytest.raises(ValueError):
        wf.stack_scene(None_frame(), None_frame(), None, (0, 0, 1, 1), lambda df: df, {})


def None_frame():
    class Columns:
        columns = ["row_idx", "col_idx"]

    return Columns()


def test_crop_window_and_metadata(spark):
    grids = spark.createDataFrame([("a", 10.0, -10.0, 100.0, 500.0, 5, 3), ("far", 10.0, -10.0, 9000.0, 500.0, 5, 3)], "raster_id string, a double, e double, c double, f double, width int, height int")
    got = g.crop_window(grids, [(112.0, 489.0), (131.0, 489.0), (120.0, 300.0)]).collect()
    assert [(x.raster_id, x.col_off, x.row_off, x.c, x.f, x.width, x.height) for x in got] == [("a", 1, 1, 110.0, 490.0, 3, 2)]
    assert g.set_metadata(grids, width=7).first().width == 7
    with pytest.raises(ValueError):
        g.set_metadata(grids, colour=1)


def test_bilinear(spark):
    flat = as_dict(r.resample_bilinear(grid_of(spark, [[4.0] * 3] * 2), ["v"], 2, 2, 3), "v")
    assert len(flat) == 24 and all(abs(v - 4) < 1e-12 for v in flat.values())
    ramp = as_dict(r.resample_bilinear(grid_of(spark, [[0.0, 4.0]]), ["v"], 2, 1, 2), "v")
    assert [round(ramp[0, j], 9) for j in range(4)] == [0.0, 1.0, 3.0, 4.0]


def test_requirements(spark):
    with pytest.raises(ValueError):
        ct.require_matches(ct.scene_catalog(spark.createDataFrame([("x",)], "fname string")))
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, None, 0.0)], "point_id long, x double, y double")
    assert [p.point_id for p in sp.clip_points(pts, 0.0, 0.0, 1.0, 1.0).collect()] == [1]
    mask = as_dict(r.raster_to_mask(grid_of(spark, [[3, 1, None]], kind="int"), "v", [3]), "v")
    assert mask == {(0, 0): 1, (0, 1): 0, (0, 2): 0}


def test_registered_forests_are_full_size(spark, small, monkeypatch):
    """The queries train what the operators' defaults and the original say: 200 trees, 30 runs."""
    from pyspark.ml.classification import RandomForestClassifier

    from gridloom.plans import analysis

    class Seen(Exception):
        pass

    def fit(self, data):
        raise Seen(self.getNumTrees(), self.getMaxDepth())

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    for name in ("rf_report", "rf_predict", "predict_map"):
        with pytest.raises(Seen) as seen:
            analysis.queries()[name](spark, small)
        assert seen.value.args == (200, 10)
    runs = []
    monkeypatch.setattr(analysis.cl, "repeated_runs", lambda *a, **k: runs.append((a[2], k)))
    analysis.queries()["rf_report"](spark, small)
    assert runs == [(30, {})]
