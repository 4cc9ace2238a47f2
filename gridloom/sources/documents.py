"""Training sets and class maps as JSON documents, encoded twice on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING = "X array<array<double>>, y array<int>, labels_map map<string,string>"


def encode_twice(value: Column) -> Column:
    """JSON text as a JSON string again, the form the files have."""
    text = F.to_json(value)
    inner = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), inner, F.lit('"'))


def decode_twice(text: Column, schema: str) -> Column:
    """The value of a doubly encoded document; null if it is none."""
    once = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.from_json(once, schema)


def training_document(samples: DataFrame, order: str, labels: DataFrame) -> DataFrame:
    """``(document,)``: one text with X, y and labels_map.

    A document holds the whole training set, so it is as large as that; keep
    large sets as tables.
    """
    rows = samples.agg(F.array_sort(F.collect_list(F.struct(order, "features", "label"))).alias("r")).withColumn("one", F.lit(1))
    names = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("classname", "id")))).alias("labels_map")).withColumn("one", F.lit(1))
    doc = F.struct(F.col("r.features").alias("X"), F.col("r.label").alias("y"), "labels_map")
    return rows.join(names, "one").select(encode_twice(doc).alias("document"))


def training_documents(samples: DataFrame, order: str, labels: DataFrame, rows: int) -> DataFrame:
    """``(number, document)``: as :func:`training_document`, with at most ``rows`` samples in a document.

    A set of any size becomes documents of bounded size; each has all labels.
    """
    from gridloom.operators.sampling import chunks

    parts = chunks(samples.select(order, "features", "label"), order, rows).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(order, "features", "label"))).alias("r"))
    names = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("classname", "id")))).alias("labels_map"))
    doc = F.struct(F.col("r.features").alias("X"), F.col("r.label").alias("y"), "labels_map")
    return parts.withColumn("one", F.lit(1)).join(F.broadcast(names.withColumn("one", F.lit(1))), "one").select(F.col("chunk").alias("number"), encode_twice(doc).alias("document"))  # one row


def training_labels(documents: DataFrame) -> DataFrame:
    """``(classname, id)`` of documents, each entry once."""
    parsed = documents.select(decode_twice(F.col("document"), TRAINING)["labels_map"].alias("m"))
    return parsed.select(F.explode("m").alias("classname", "id")).distinct()


def training_rows(documents: DataFrame, rows: int | None = None) -> DataFrame:
    """``(pos, features, label)`` of documents; ``pos`` counts within each, or over numbered ones of ``rows`` samples."""
    first = F.lit(0) if rows is None else (F.col("number") * rows).cast("int")
    parsed = documents.select(first.alias("first"), decode_twice(F.col("document"), TRAINING).alias("d"))
    each = parsed.select("first", F.posexplode(F.arrays_zip("d.X", "d.y")).alias("pos", "z"))
    return each.select((F.col("first") + F.col("pos")).alias("pos"), F.col("z.X").alias("features"), F.col("z.y").alias("label"))


def class_map_rows(pixels: DataFrame) -> DataFrame:
    """``(row_idx, values)``: the JSON array of each map row, in column order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "prediction"))), lambda s: s["prediction"])
    return pixels.groupBy("row_idx").agg(F.to_json(line).alias("values"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One line per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, order: list[str], path: str) -> None:
    """One line per row, in order from the first part of the output to the last."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.trim("value").alias("document"))
