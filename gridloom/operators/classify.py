"""Random forests on samples and pixels, and accuracy reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.functions.numeric import finite_or_zero
from gridloom.session import activate, cut


def confusion(predictions: DataFrame) -> DataFrame:
    """``(truth, prediction, n)`` of all observed pairs of labels."""
    return predictions.groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(predictions: DataFrame) -> DataFrame:
    """As :func:`confusion`, with a 0 for every pair of labels that does not occur.

    The labels (the classes, not the rows) are joined through one constant key.
    """
    counts = confusion(predictions)
    labels = counts.select(F.col("truth").alias("label")).union(counts.select("prediction")).distinct().withColumn("one", F.lit(1))
    grid = labels.withColumnRenamed("label", "truth").join(labels.withColumnRenamed("label", "prediction"), "one").drop("one")
    return grid.join(counts, ["truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def accuracy_kappa(predictions: DataFrame) -> DataFrame:
    """One row: overall accuracy and Cohen's kappa; nulls for an empty table.

    Kappa is ``1 - sum of n_ij / sum of row_i * col_j / N`` over i <> j. The sum
    of products over i <> j is the product of the sums minus that over i = j, so
    only marginals are needed.
    """
    return _scores(confusion(predictions))


def _scores(counts: DataFrame) -> DataFrame:
    rows = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("r"))
    cols = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("c"))
    same = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("same"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("right"))
    both = total.withColumn("one", F.lit(1)).join(same.withColumn("one", F.lit(1)), "one")
    t = F.col("total").cast("double")
    kappa = 1 - F.try_divide(t - F.col("right"), (t * t - F.col("same")) / t)
    return both.select(F.bround(F.try_divide(F.col("right"), t), 8).alias("accuracy"), F.bround(kappa, 8).alias("kappa"))


def class_errors(predictions: DataFrame) -> DataFrame:
    """Per label: commission and user's accuracy by rows (truth), omission and producer's by columns, in percent.

    Rows are true labels, so against the usual convention the names are swapped;
    this is the behaviour to match.
    """
    return _errors(confusion(predictions))


def _errors(counts: DataFrame) -> DataFrame:
    right = counts.filter("truth = prediction").select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    rows = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("r"))
    cols = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("c"))
    joined = rows.join(cols, "label", "full").join(right, "label", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    share = lambda v: F.bround(F.try_divide(F.col("hit"), F.col(v)), 2)
    lost = lambda v: F.bround(F.try_divide(F.col(v) - F.col("hit"), F.col(v)), 2)
    return joined.select("label", lost("r").alias("commission"), share("r").alias("user"), lost("c").alias("omission"), share("c").alias("producer"))


def classification_report(predictions: DataFrame, without: int = 0) -> DataFrame:
    """``(metric, truth, prediction, value)``: confusion, accuracy, kappa and class errors, without the last ``without`` labels.

    The counts of all pairs of labels are taken once; a label that has fallen
    out takes its rows and columns with it before anything is scored.
    """
    counts = confusion(predictions)
    labels = counts.select(F.col("truth").alias("label")).union(counts.select("prediction")).distinct()
    if without:
        kept = labels.withColumn("r", F.row_number().over(Window.orderBy(F.desc("label")))).filter(F.col("r") > without).select("label")  # labels, not rows
        counts = counts.join(kept.select(F.col("label").alias("truth")), "truth").join(kept.select(F.col("label").alias("prediction")), "prediction").select("truth", "prediction", "n")
    kind = predictions.schema["truth"].dataType
    none = F.lit(None).cast(kind)
    errors = ("commission", "omission", "user", "producer")
    cells = counts.select(F.lit("confusion").alias("metric"), "truth", F.col("prediction").cast(kind).alias("prediction"), F.col("n").cast("double").alias("value"))
    scores = _scores(counts).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "kappa")])).alias("s")).select("s.metric", none.alias("truth"), none.alias("prediction"), "s.value")
    single = _errors(counts).select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in errors])).alias("s")).select("s.metric", F.col("label").cast(kind).alias("truth"), none.alias("prediction"), "s.value")
    return cells.unionByName(scores).unionByName(single)


def without_last_classes(matrix: DataFrame, k: int = 2) -> DataFrame:
    """A confusion matrix without its last ``k`` labels, on both axes."""
    labels = matrix.select(F.col("truth").alias("label")).union(matrix.select("prediction")).distinct()
    ranked = labels.withColumn("r", F.row_number().over(Window.orderBy(F.desc("label"))))
    kept = ranked.filter(F.col("r") > k)
    return matrix.join(kept.select(F.col("label").alias("truth")), "truth").join(kept.select(F.col("label").alias("prediction")), "prediction")


def _vectors(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    clean = F.transform(F.col(features).cast("array<double>"), finite_or_zero)
    return df.withColumn("_features", array_to_vector(clean))


#: Samples that are worth a task of their own in training, and from which on tasks grow whole trees.
TASK_SAMPLES, TREE_SAMPLES = 1000, 200_000


def train_forest(samples: DataFrame, features: str = "features", label: str = "label", trees: int = 200, seed: int = 42, depth: int = 10):
    """A random forest fitted on all samples; NaN and infinities count as 0.

    Every level of the trees is a pass over the samples, in which each task sums
    up statistics of all nodes. Samples that lie in no more partitions than there
    are cores are counted and spread anew, by a hash of their features, over as
    many tasks as have work for it; the node that each sample has reached is
    kept between the passes. Of more than TREE_SAMPLES samples every task grows
    whole trees (:func:`grow_forest`), as long as one can hold them condensed.
    """
    from pyspark.ml.classification import RandomForestClassifier

    from gridloom.operators.forest import grow_forest

    cores, count = samples.sparkSession.sparkContext.defaultParallelism, samples.count()
    if count > TREE_SAMPLES and (grown := grow_forest(samples, features, label, trees, seed, depth)) is not None:
        return grown
    if samples.rdd.getNumPartitions() <= cores:
        samples = samples.repartition(max(1, min(cores, -(-count // TASK_SAMPLES))), F.xxhash64(features, label))
    data = _vectors(samples, features).select("_features", F.col(label).cast("double").alias("_label"))
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512, cacheNodeIds=True).fit(data)


def predict(pixels: DataFrame, model, features: str = "features") -> DataFrame:
    """Adds prediction to every row: a projection, the tasks are the windows."""
    out = model.transform(_vectors(pixels, features))
    return out.withColumn("prediction", F.col("prediction").cast("bigint")).drop("_features", "rawPrediction", "probability")


def predict_alike(pixels: DataFrame, model, features: str = "features") -> DataFrame:
    """As :func:`predict`, for forests that take longer than a join: equal vectors (masked cells, say) are predicted once."""
    kinds = pixels.select(features).distinct().repartition(4 * pixels.sparkSession.sparkContext.defaultParallelism)
    return pixels.join(predict(kinds, model, features), features)


#: Bytes that a foreign classifier may have to be sent to the executors.
MODEL_BYTES = 512_000_000


def predict_batches(pixels: DataFrame, model, features: str = "features") -> DataFrame:
    """Adds prediction by any classifier with ``predict(matrix)``, in batches; NaN, infinities and nulls count as 0.

    The classifier is pickled and sent once to every executor; one of more than
    MODEL_BYTES, and vectors of different lengths, are a ``ValueError``. A null
    vector gets a null.
    """
    import pickle

    packed = pickle.dumps(model)
    if len(packed) > MODEL_BYTES:
        raise ValueError(f"the classifier has {len(packed)} bytes, more than {MODEL_BYTES}")
    sent = pixels.sparkSession.sparkContext.broadcast(packed)
    clean = pixels.withColumn("_features", F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(finite_or_zero(v), F.lit(0.0))))
    schema = StructType([*pixels.schema.fields, StructField("prediction", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)  # what this session's user has passed
        for batch in batches:
            *rest, vectors = batch.columns
            there = np.flatnonzero(np.asarray(vectors.is_valid()))
            out: list[int | None] = [None] * batch.num_rows
            if len(there):
                sizes = vectors.drop_null().value_lengths().unique()
                if len(sizes) > 1:
                    raise ValueError("vectors of different lengths")
                matrix = np.asarray(vectors.drop_null().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(there), -1)
                for i, p in zip(there.tolist(), np.asarray(own.predict(matrix)).tolist()):
                    out[i] = int(p)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "prediction"])

    return clean.select(*pixels.columns, "_features").mapInArrow(run, schema)


def train_and_report(samples: DataFrame, key: str, trees: int = 200, test_share: float = 0.3, seed: int = 42, depth: int = 10):
    """A forest on a stratified part of the samples: ``(model, report)``.

    ``report`` is ``(part, accuracy, kappa)`` for the training and the test rows.
    """
    model, split = _trained(samples, key, trees, test_share, seed, depth)
    alike = split.groupBy("features", "is_test", F.col("label").alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    once = alike.groupBy("features").agg(F.collect_list(F.struct("is_test", "truth", "n")).alias("s"))  # at most two rows a label
    done = predict(once.repartition(4 * samples.sparkSession.sparkContext.defaultParallelism), model).select("prediction", F.explode("s").alias("s"))
    counts = cut(done.groupBy("s.is_test", "s.truth", "prediction").agg(F.sum("s.n").alias("n")), "counts")  # equal vectors are predicted once
    parts = [_scores(counts.filter(F.col("is_test") == F.lit(t))).withColumn("part", F.lit(name)) for t, name in ((False, "train"), (True, "test"))]
    return model, parts[0].unionByName(parts[1]).select("part", "accuracy", "kappa")


def train_and_predict(samples: DataFrame, key: str, trees: int = 200, test_share: float = 0.3, seed: int = 42, depth: int = 10):
    """``(model, predictions)``: a forest on a stratified part of the samples, and (is_test, truth, prediction) of all of them."""
    model, split = _trained(samples, key, trees, test_share, seed, depth)
    return model, predict(split, model).select("is_test", F.col("label").alias("truth"), "prediction")


def _trained(samples: DataFrame, key: str, trees: int, test_share: float, seed: int, depth: int):
    """``(model, split)``: a forest, and the samples with is_test, split once for all passes over them."""
    from gridloom.operators.sampling import stratified_split

    split = cut(stratified_split(samples, key, "label", test_share, seed).select("features", "label", "is_test"), "split")
    return train_forest(split.filter("not is_test"), trees=trees, seed=seed, depth=depth), split


def full_report(done: DataFrame, without: int = 0) -> DataFrame:
    """``(part, metric, truth, prediction, value)`` of (is_test, truth, prediction): a report of the training and one of the test rows."""
    parts = [classification_report(done.filter(F.col("is_test") == F.lit(t)).select("truth", "prediction"), without).withColumn("part", F.lit(name)) for t, name in ((False, "train"), (True, "test"))]
    return parts[0].unionByName(parts[1]).select("part", "metric", "truth", "prediction", "value")


def repeated_runs(samples: DataFrame, key: str, runs: int, at_once: int = 4, then: Callable | None = None, **options) -> DataFrame:
    """Reports of several runs, each with its own split and forest, by run number.

    ``at_once`` runs share the cores, since the levels of one forest leave gaps;
    a report is two rows, which each run reads. ``then(run, model)`` is called
    with every forest, to map or to keep it.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    def one(run: int) -> list[tuple]:
        activate(samples.sparkSession)
        model, report = train_and_report(samples, key, seed=run, **options)
        if then is not None:
            then(run, model)
        return [(run, r.part, r.accuracy, r.kappa) for r in report.collect()]

    with ThreadPool(at_once) as pool:
        rows = [r for got in pool.imap(inheritable_thread_target(samples.sparkSession)(one), range(1, runs + 1)) for r in got]
    return samples.sparkSession.createDataFrame(rows, "run int, part string, accuracy double, kappa double")
