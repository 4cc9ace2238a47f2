"""Random forests whose tasks grow whole trees from a condensed training set.

Spark's own trainer sums up statistics of all nodes of all trees in every task and
keeps two numbers a tree for every sample. Here features become one byte each (the
interval between quantiles, as many as Spark has), equal samples of a label become
one row with a count, and a task reads those rows once and grows its share of the
trees. The bootstrap draws a Poisson number of mean n for a row that stands for n
samples, which is the sum of n draws of mean 1. Impurity, choice of features, limits
and pruning are Spark's, and so is the model that comes out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite_or_zero

#: Intervals of a feature, as in Spark; bytes of condensed rows that a task may hold; numbers of a level's histogram.
BINS, HELD_BYTES, HISTOGRAM = 32, 150_000_000, 4_000_000
#: Rows whose statistics are summed up at a time.
CHUNK = 1 << 17
NODES = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"


def grow_forest(samples: DataFrame, features: str, label: str, trees: int, seed: int, depth: int):
    """A forest of Spark's class, or None where the condensed samples are too large for a task or no whole labels from 0."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from gridloom.session import cut, discard, scratch

    spark = samples.sparkSession
    clean = samples.select(F.transform(F.col(features).cast("array<double>"), finite_or_zero).alias("x"), F.col(label).cast("double").alias("y"))
    seen = clean.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("width"), F.min("y").alias("low"), F.max("y").alias("high"), F.count_if(F.col("y").isNull() | (F.col("y") != F.floor("y")) | F.exists("x", F.isnull)).alias("odd")).first()
    if not seen.least or seen.least < 1 or seen.least != seen.width or seen.odd or seen.low < 0:
        return None
    width, classes = seen.width, int(seen.high) + 1
    if (1 << depth) * (BINS + 1) * classes > HISTOGRAM:
        return None
    share = F.array(*[F.lit(k / BINS) for k in range(BINS + 1)])
    places = clean.agg(*[F.percentile_approx(F.col("x")[k], share, 1000).alias(f"q{k}") for k in range(width)]).first()
    edges = [np.unique(np.array(q))[:-1] for q in places]  # x <= edge goes left; nothing is beyond the largest value

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = np.column_stack([np.searchsorted(edges[k], matrix[:, k], side="left") for k in range(width)]).astype(np.uint8)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bins.tobytes())]), batch.column("y").cast(pa.int32())], names=["bins", "y"])

    rows = cut(clean.mapInArrow(place, "bins binary, y int").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n")), "binned")
    if rows.count() * (width + 16) > HELD_BYTES:
        discard(rows)
        return None
    path, tasks = rows._gridloom_path, min(trees, 2 * spark.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, n = read_rows(path, width)
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                nodes = grow_tree(bins, y, n, [len(e) for e in edges], classes, depth, np.random.default_rng([seed % (1 << 32), tree]))
                yield pa.RecordBatch.from_pylist([{"treeID": tree, "nodeData": node} for node in node_rows(nodes, edges)], schema=_SCHEMA)

    with scratch(spark, "forest") as folder:
        spark.range(0, trees, 1, tasks).mapInArrow(grow, NODES).write.parquet(f"{folder}/data")
        discard(rows)
        uid, common = uuid.uuid4().hex[:12], {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        known = {"featuresCol": "_features", "labelCol": "_label", "maxDepth": depth, "seed": seed}
        rest = {"cacheNodeIds": False, "checkpointInterval": 10, "featuresCol": "features", "impurity": "gini", "labelCol": "label", "leafCol": "", "maxBins": BINS, "maxDepth": 5, "maxMemoryInMB": 256, "minInfoGain": 0.0, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}
        kind = "org.apache.spark.ml.classification."
        sizes = {"numFeatures": width, "numClasses": classes}
        whole = common | sizes | {"class": f"{kind}RandomForestClassificationModel", "uid": f"RandomForestClassifier_{uid}", "paramMap": known | {"numTrees": trees}, "defaultParamMap": rest | {"bootstrap": True, "featureSubsetStrategy": "auto", "numTrees": 20, "subsamplingRate": 1.0}, "numTrees": trees}
        each = [json.dumps(common | sizes | {"class": f"{kind}DecisionTreeClassificationModel", "uid": f"dtc_{uid}_{t}", "paramMap": known, "defaultParamMap": rest}) for t in range(trees)]
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        spark.createDataFrame([(t, m, 1.0) for t, m in enumerate(each)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
        return RandomForestClassificationModel.load(folder)


_SCHEMA = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))]))])


def read_rows(path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, labels and counts of the condensed samples, in an order of their own."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    from gridloom.sources.geotiff import _fs

    fs, at = _fs(path)
    parts = []
    for f in sorted((f for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")), key=lambda f: f.path):
        with fs.open_input_file(f.path) as file:
            t = pq.read_table(file, use_threads=False).combine_chunks()
        if t.num_rows:
            flat = t.column("bins").cast(pa.binary(width)).combine_chunks()
            parts.append((np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * width :][: t.num_rows * width].reshape(-1, width), t.column("y").to_numpy().astype(np.int32), t.column("n").to_numpy()))
    bins, y, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((y, *(bins[:, k] for k in range(width))))  # the same trees however rows were spread
    return bins[order], y[order], n[order]


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (stats * stats).sum(-1) / (total * total), 0.0)


def grow_tree(bins: np.ndarray, y: np.ndarray, n: np.ndarray, edges: list[int], classes: int, depth: int, rng: np.random.Generator) -> list[list]:
    """``[stats, feature or -1, edge, gain, left, right]`` by node, level by level, of one bootstrap sample."""
    width, per = bins.shape[1], max(edges) + 1
    pick = max(1, int(np.ceil(np.sqrt(width))))
    w = rng.poisson(n)
    kept = np.flatnonzero(w)
    bins, y, w = bins[kept], y[kept], w[kept].astype(float)
    nodes = [[np.bincount(y, w, classes), -1, 0, -1.0, -1, -1]]
    active = [0] if depth and _gini(nodes[0][0]) > 0 else []
    at = np.zeros(len(y), np.int32)
    lines = np.arange(CHUNK, dtype=np.int64) * width
    for level in range(depth):
        m = len(active)
        if not m:
            break
        chosen = np.argsort(rng.random((m, width)), axis=1)[:, :pick].astype(np.int32)
        size = m * per * classes
        sums = np.zeros((pick, size))
        for lo in range(0, len(y), CHUNK):
            a = at[lo : lo + CHUNK]
            flat, own = bins[lo : lo + CHUNK].reshape(-1), w[lo : lo + CHUNK]
            base = a.astype(np.int64) * (per * classes) + y[lo : lo + CHUNK]
            for s in range(pick):
                value = flat.take(lines[: len(a)] + chosen[:, s].take(a))
                sums[s] += np.bincount(base + value.astype(np.int64) * classes, own, size)
        best, edge, feature = np.zeros(m), np.zeros(m, np.int32), np.full(m, -1, np.int32)
        lefts = np.zeros((m, classes))
        every = np.array([nodes[k][0] for k in active])
        total, whole = every.sum(1), _gini(every)
        for s in range(pick):
            left = sums[s].reshape(m, per, classes).cumsum(1)[:, :-1]
            if not left.shape[1]:
                continue
            right = every[:, None] - left
            nl, nr = left.sum(-1), right.sum(-1)
            gain = whole[:, None] - (nl * _gini(left) + nr * _gini(right)) / total[:, None]
            gain = np.where((nl >= 1) & (nr >= 1), gain, -1.0)
            where = gain.argmax(1)
            top = gain[np.arange(m), where]
            better = top > np.maximum(best, 1e-12)  # rounding makes no gain
            best[better], edge[better], feature[better] = top[better], where[better], chosen[better, s]
            lefts[better] = left[better, where[better]]
        children, following = np.full(2 * m, -1, np.int32), []
        for k in np.flatnonzero(feature >= 0).tolist():
            node = nodes[active[k]]
            node[1:] = [int(feature[k]), int(edge[k]), float(best[k]), len(nodes), len(nodes) + 1]
            for side, stats in enumerate((lefts[k], node[0] - lefts[k])):
                if level + 1 < depth and np.count_nonzero(stats) > 1:
                    children[2 * k + side] = len(following)
                    following.append(len(nodes))
                nodes.append([stats, -1, 0, -1.0, -1, -1])
        if not following:
            break
        turn = np.empty(len(y), np.int32)
        for lo in range(0, len(y), CHUNK):
            a = at[lo : lo + CHUNK]
            value = bins[lo : lo + CHUNK].reshape(-1).take(lines[: len(a)] + np.maximum(feature, 0).take(a))
            turn[lo : lo + CHUNK] = children.take(2 * a + (value > edge.take(a)))
        stay = turn >= 0
        bins, y, w, at, active = (bins[stay], y[stay], w[stay], turn[stay], following) if not stay.all() else (bins, y, w, turn, following)
    return nodes


def node_rows(nodes: list[list], edges: list[np.ndarray]) -> list[dict]:
    """The nodes as Spark stores them, in preorder; leaves side by side of one prediction become their parent."""
    guess = [int(np.argmax(v[0])) for v in nodes]
    for v in reversed(nodes):  # children come after their parents
        if v[1] >= 0 and nodes[v[4]][1] < 0 and nodes[v[5]][1] < 0 and guess[v[4]] == guess[v[5]]:
            v[1:] = [-1, 0, -1.0, -1, -1]
    out: list[dict] = []
    stack = [(0, None, "")]
    while stack:
        k, parent, side = stack.pop()
        stats, feature, edge, gain, left, right = nodes[k]
        if parent is not None:
            out[parent][side] = len(out)
        split = {"featureIndex": feature, "leftCategoriesOrThreshold": [float(edges[feature][edge])] if feature >= 0 else [], "numCategories": -1}
        if feature >= 0:
            stack += [(right, len(out), "rightChild"), (left, len(out), "leftChild")]
        out.append({"id": len(out), "prediction": float(guess[k]), "impurity": float(_gini(stats)), "impurityStats": stats.tolist(), "rawCount": int(stats.sum()), "gain": gain, "leftChild": -1, "rightChild": -1, "split": split})
    return out
