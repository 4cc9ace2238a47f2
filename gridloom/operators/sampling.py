"""Samples at points, training-set editing and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import cell_of

MASK = 9999
#: Ranges of the hash that a split counts per label.
SPLIT_RANGES = 1024


def points_to_pixels(points: DataFrame, pixels: DataFrame, transform: tuple[float, float, float, float]) -> DataFrame:
    """Points with the values of the pixel they lie in; points outside the grid drop out.

    The point's cell is computed, so this is an equi-join on the cell.
    """
    row, col = cell_of(F.col("x"), F.col("y"), *transform)
    return points.withColumns({"row_idx": row, "col_idx": col}).join(pixels, ["row_idx", "col_idx"])


def extract(points: DataFrame, pixels: DataFrame, bands: list[str], transform: tuple[float, float, float, float], mask=MASK) -> DataFrame:
    """``(point_id, features, label)``; a point is dropped only if every band is the mask."""
    got = points_to_pixels(points, pixels, transform)
    features = F.array(*[F.col(b).cast("double") for b in bands])
    return got.select("point_id", features.alias("features"), F.col("id").cast("int").alias("label")).filter(~F.forall("features", lambda v: F.coalesce(v == mask, F.lit(False))))


def clip_points(points: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Points inside a raster's bounds, its border included."""
    return points.filter(F.col("x").between(left, right) & F.col("y").between(bottom, top))


def labels_map(points: DataFrame, order: str) -> DataFrame:
    """``(classname, id)``: the first id of every class."""
    return points.filter("classname is not null").groupBy("classname").agg(F.min_by(F.col("id").cast("string"), order).alias("id"))


def add_class(samples: DataFrame, width: int, value: float) -> DataFrame:
    """Adds a class of constant rows, as many as the largest class has; its label is the largest plus one.

    The counts are one aggregated row; the new rows are generated where they are used.
    """
    sizes = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), (F.max("label") + 1).alias("label"))
    fresh = sizes.filter("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "label")
    return samples.select("features", "label").unionByName(fresh.select(F.array_repeat(F.lit(float(value)), width).alias("features"), F.col("label").cast(samples.schema["label"].dataType).alias("label")))


def label_of(labels: DataFrame, name: str) -> int:
    """The label id of a class; an unknown class is a ``KeyError``."""
    row = labels.filter(F.col("classname") == name).select(F.trim("id").try_cast("double").cast("int").alias("id")).first()
    if row is None or row.id is None:
        raise KeyError(name)
    return row.id


def set_label(labels: DataFrame, name: str, label: int) -> DataFrame:
    """``(classname, id)`` with a class set to a label, whether it was there or not."""
    fresh = labels.sparkSession.createDataFrame([(name, str(label))], "classname string, id string")
    return delete_label(labels, name).select("classname", F.col("id").cast("string").alias("id")).unionByName(fresh)


def delete_label(labels: DataFrame, name: str) -> DataFrame:
    """``(classname, id)`` without a class."""
    return labels.filter(~F.col("classname").eqNullSafe(F.lit(name)))


def add_named_class(samples: DataFrame, labels: DataFrame, name: str, width: int, value: float) -> tuple[DataFrame, DataFrame]:
    """:func:`add_class` with an entry in the table of labels; of no samples none is added."""
    top = samples.agg(F.max("label")).first()[0]
    return add_class(samples, width, value), labels if top is None else set_label(labels, name, top + 1)


def remove_named_class(samples: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The samples and the table of labels without a class; an unknown one is a ``KeyError``."""
    return remove_class(samples, label_of(labels, name)), delete_label(labels, name)


def remove_class(samples: DataFrame, label: int) -> DataFrame:
    """All rows but those of one class; rows without label stay."""
    return samples.filter(~F.coalesce(F.col("label") == label, F.lit(False)))


def band_columns(samples: DataFrame, width: int) -> DataFrame:
    """Columns Band1 to BandN and labels; short rows give nulls."""
    return samples.select(*[F.try_element_at("features", F.lit(i + 1)).alias(f"Band{i + 1}") for i in range(width)], F.col("label").alias("labels"))


def stratified_split(samples: DataFrame, key: str, label: str, test_share: float, seed: int = 42) -> DataFrame:
    """Adds is_test: exactly the rounded-up share of every label, by a hash order of the key.

    Rows of equal key and label count one by one if their keys differ from all
    others'; give a key that is unique. The order is cut at one place per label:
    counts by ranges of the hash find the range that holds it, only the keys of
    that range are ranked, and all rows are compared with the place, so none is
    sorted and only keys and labels are read for it.
    """
    place = F.struct(F.pmod(F.shiftright(F.xxhash64(F.col(key), F.lit(seed)), 20), F.lit(SPLIT_RANGES)).alias("b"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k"))
    keyed = samples.select(F.col(label).alias("_label"), place.alias("_at"))
    sizes = keyed.groupBy("_label", F.col("_at.b").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_label").orderBy("_b")  # at most SPLIT_RANGES rows a label
    sizes = sizes.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).withColumn("_want", F.ceil(F.sum("_n").over(Window.partitionBy("_label")) * test_share))
    edge = sizes.filter("_before < _want and _before + _n >= _want").select(F.col("_label").alias("_own"), "_b", (F.col("_want") - F.col("_before")).alias("_rank"))
    ranked = keyed.join(edge, F.expr("_label <=> _own and _at.b = _b")).withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy("_at")))
    last = ranked.filter("_r = _rank").select(F.col("_label").alias("_own"), F.col("_at").alias("_last"))
    joined = samples.withColumn("_at", place).join(last, F.col(label).eqNullSafe(F.col("_own")), "left")
    return joined.withColumn("is_test", F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))).drop("_at", "_own", "_last")


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: numbers from 0 of consecutive runs of ``size`` rows; the last is shorter."""
    from gridloom.operators.overlap import number_rows

    return number_rows(df, order, "_number").withColumn("chunk", F.floor((F.col("_number") - 1) / size)).drop("_number")


def outside_cover(points: DataFrame, pixels: DataFrame, value: Column, transform: tuple[float, float, float, float], block: int, threshold: float) -> DataFrame:
    """Points strictly inside a block of the raster, with ``taken``: is the pixel's value neither above the threshold nor 0?

    Adds tile_row and tile_col, the block that the point lies in.
    """
    from gridloom.operators.grid import strictly_within

    a, e, c, f = transform
    seen = points_to_pixels(points, pixels, transform).withColumn("_v", value)
    seen = seen.withColumns({"tile_row": F.floor(F.col("row_idx") / block), "tile_col": F.floor(F.col("col_idx") / block)})
    left, top = c + F.col("tile_col") * block * a, f + F.col("tile_row") * block * e
    inside = strictly_within(F.col("x"), F.col("y"), left, top + block * e, left + block * a, top)
    return seen.filter(inside).withColumn("taken", F.coalesce(~(F.col("_v") > threshold) & (F.col("_v") != 0), F.lit(False))).drop("_v")


def cover_counts(points: DataFrame, seen: DataFrame) -> DataFrame:
    """One row of counters: all points, those within the raster, taken and excluded ones, and blocks with a taken point."""
    block = F.when(F.col("taken"), F.struct("tile_row", "tile_col"))
    found = seen.agg(F.count(F.lit(1)).alias("found"), F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("excluded"), F.count_distinct(block).alias("blocks")).withColumn("one", F.lit(1))
    return points.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1)).join(found, "one").drop("one")  # one row each


def front_pairs(df: DataFrame, key: str) -> DataFrame:
    """``(a, b)``: every pair of different values, the smaller first.

    The pairs of n values are n (n - 1) / 2 rows by definition; each value joins
    the values of the same group only, so give a group to keep them few.
    """
    return df.select(F.col(key).alias("a"), "grp").join(df.select(F.col(key).alias("b"), "grp"), "grp").filter("a < b").select("grp", "a", "b")


def class_counts(samples: DataFrame, label: str) -> DataFrame:
    return samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def all_masked(features: Column, mask=MASK) -> Column:
    return F.forall(features, lambda v: F.coalesce(v == mask, F.lit(False)))
