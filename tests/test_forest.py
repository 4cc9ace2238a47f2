"""Forests grown by whole trees, and tiles gathered before they are moved."""

import numpy as np
import pytest

from gridloom.operators import classify as cl
from gridloom.operators import forest as fo
from gridloom.sources import geotiff as gt


def samples(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(1.5 * (i % 4), 1, 3)] + [9999.0], i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "k long, features array<double>, label int")


def test_large_sets_grow_whole_trees(spark, monkeypatch):
    """More than TREE_SAMPLES samples need no pass over statistics of all trees, and learn as well."""
    from pyspark.ml.classification import RandomForestClassifier

    df, fresh = samples(spark), samples(spark, seed=4)
    right = lambda model: cl.predict(fresh, model).filter("prediction = label").count()
    usual = right(cl.train_forest(df, trees=30, depth=6))

    def fit(self, data):
        raise AssertionError("Spark's own trainer was called")

    monkeypatch.setattr(cl, "TREE_SAMPLES", 1000)
    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    model = cl.train_forest(df, trees=30, depth=6)
    assert (model.getNumTrees, model.numFeatures, model.numClasses, model.getOrDefault("maxDepth")) == (30, 4, 4, 6)
    assert abs(right(model) - usual) < 0.02 * 4000
    assert max(t.depth for t in model.trees) <= 6 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 30
    again = cl.train_forest(df.repartition(7), trees=30, depth=6)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_what_a_task_cannot_hold_is_left_to_spark(spark, monkeypatch):
    df = samples(spark, 200)
    assert fo.grow_forest(df.withColumn("label", df.label - 1), "features", "label", 3, 1, 3) is None
    assert fo.grow_forest(df.withColumn("label", df.label * 100_000), "features", "label", 3, 1, 3) is None
    monkeypatch.setattr(fo, "HELD_BYTES", 100)
    assert fo.grow_forest(df, "features", "label", 3, 1, 3) is None


def test_counts_stand_for_samples():
    """A tree of rows with counts splits where the rows one by one would, and every node has the sum of its children."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (300, 3)).astype(np.uint8)
    y = (bins[:, 0] > 3).astype(np.int32)
    nodes = fo.grow_tree(bins, y, np.full(300, 50), [7, 7, 7], 2, 4, rng)
    assert 0.95 < nodes[0][0].sum() / 15_000 < 1.05
    for stats, feature, _, gain, left, right in nodes:
        assert feature < 0 or (gain > 0 and (nodes[left][0] + nodes[right][0] == stats).all())
    assert all(np.count_nonzero(v[0]) == 1 for v in nodes if v[1] < 0)
    rows = fo.node_rows(nodes, [np.arange(7.0)] * 3)
    assert all(r["leftChild"] == r["id"] + 1 for r in rows if r["leftChild"] >= 0)
    assert [r["split"]["featureIndex"] for r in fo.node_rows(fo.grow_tree(bins, y * 0, np.full(300, 1), [7, 7, 7], 2, 4, rng), [np.arange(7.0)] * 3)] == [-1]


def test_pixels_meet_few_grids_where_they_are(spark, tmp_path, monkeypatch):
    """The pixels of one raster are neither sent to one task nor multiplied with the grids' tasks, and move as parts of tiles."""
    from gridloom import session

    plans = {}
    plain = session.cut

    def cut(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(session, "cut", cut)
    grids = spark.createDataFrame([("one", 100, 100, 1.0, -1.0, 0.0, 0.0)], "raster_id string, width int, height int, a double, e double, c double, f double")
    cells = spark.range(0, 10_000, 1, 3).selectExpr("'one' as raster_id", "1 as band", "id div 100 as row_idx", "id % 100 as col_idx", "id as value")
    gt.write_rasters(cells, grids, str(tmp_path / "out"), "uint16", 64)
    assert "CartesianProduct" not in plans["tiles"] and "SortMergeJoin" not in plans["tiles"] and "MapInArrow" in plans["tiles"]
    got = {(r.row_idx, r.col_idx): r.value for r in gt.pixels_of(gt.read_rasters(spark, str(tmp_path / "out"))).collect()}
    assert got == {(i // 100, i % 100): float(i) for i in range(10_000)}


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint32", "int64", "float32", "float64"])
def test_largest_of_several_values_is_kept(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(gt, "GATHERED", 3)
    monkeypatch.setattr(gt, "GATHERED_ROWS", 2)
    values = [(0, 0, 7.0), (0, 0, 9.0), (0, 0, 8.0), (3, 3, 5.0), (1, 2, 4.0), (3, 3, 6.0), (0, 3, 1.0)]
    cells = spark.createDataFrame([("m", 1, *v) for v in values], "raster_id string, band int, row_idx long, col_idx long, value double").coalesce(1)
    grids = spark.createDataFrame([("m", 4, 4, 1.0, -1.0, 0.0, 0.0)], "raster_id string, width int, height int, a double, e double, c double, f double")
    gt.write_rasters(cells, grids, str(tmp_path / "out"), kind, 16)
    got = {(r.row_idx, r.col_idx): r.value for r in gt.pixels_of(gt.read_rasters(spark, str(tmp_path / "out"))).filter("value <> 0").collect()}
    assert got == {(0, 0): 9.0, (3, 3): 6.0, (1, 2): 4.0, (0, 3): 1.0}


def test_equal_vectors_are_predicted_once(spark, monkeypatch):
    """Reports and maps give the model every vector once, and count or place all rows."""
    df = samples(spark, 200)
    twice = df.unionByName(df.withColumn("k", df.k + 1000))
    model = cl.train_forest(df, trees=3, depth=3)
    seen, plain = [], cl.predict

    def predict(pixels, *rest):
        seen.append(pixels.count())
        return plain(pixels, *rest)

    monkeypatch.setattr(cl, "predict", predict)
    got = {r.k: r.prediction for r in cl.predict_alike(twice, model).collect()}
    assert seen == [200] and got == {r.k: r.prediction for r in plain(twice, model).collect()}
    trained, report = cl.train_and_report(twice, "k", trees=3, depth=3)
    assert seen == [200, 200]
    own = cl.accuracy_kappa(plain(cl._trained(twice, "k", 3, 0.3, 42, 3)[1].filter("is_test"), trained).withColumnRenamed("label", "truth")).first()
    assert {r.part: r.accuracy for r in report.collect()}["test"] == own.accuracy
