"""Catalogues of scene files: parsing, lookup, fallback and pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import asset_fields, basename, dirname, scene_fields, size_text, wildcard


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(fpath, fname, size_bytes)`` of a folder's files, not of folders in it. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("fpath"), F.col("length").alias("size_bytes"))
    return files.withColumn("fname", basename(F.col("fpath")))


def scene_catalog(files: DataFrame, name: str = "fname") -> DataFrame:
    """Files whose name is a scene band's, with tile_n, date, band, attr and key."""
    return files.withColumns(scene_fields(F.col(name))).filter("key is not null")


def require_matches(catalog: DataFrame) -> DataFrame:
    """The catalogue itself; an empty one is a ``ValueError``. Looks for one row."""
    if catalog.isEmpty():
        raise ValueError("no file name fits")
    return catalog


def duplicate_bands(catalog: DataFrame, group: list[str]) -> DataFrame:
    """Suffix-less bands that occur more than once in a group: a catalogue error."""
    return catalog.filter("attr = ''").groupBy(*group, "band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_of_key(catalog: DataFrame, group: list[str], order: str) -> DataFrame:
    """One file per group and key: the last in listing order wins."""
    rest = [c for c in catalog.columns if c not in (*group, "key")]
    return catalog.groupBy(*group, "key").agg(F.max_by(F.struct(*rest), order).alias("r")).select(*group, "key", "r.*")


def lookup(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The files of ``keys`` with the position of the request; missing keys are left out."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return catalog.withColumn("pos", F.array_position(wanted, F.col("key")) - 1).filter("pos >= 0")


def lookup_all(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """``(pos, key, ...)``: a row for every request, with nulls where the catalogue has no such key."""
    wanted = catalog.sparkSession.createDataFrame(list(enumerate(keys)), "pos int, key string")
    return wanted.join(catalog, "key", "left").select("pos", "key", *[c for c in catalog.columns if c != "key"])


def path_of(catalog: DataFrame, key: str) -> str:
    """The path of one band; a missing key is a ``KeyError``. Of several files the last in path order counts."""
    row = catalog.filter(F.col("key") == key).agg(F.max("fpath").alias("fpath")).first()
    if row.fpath is None:
        raise KeyError(key)
    return row.fpath


def attribute_of(catalog: DataFrame, key: str, attribute: str) -> str | None:
    """The date or tile of one band, None if the key is missing."""
    return catalog.filter(F.col("key") == key).agg(F.max_by(attribute, "fpath")).first()[0]


def band_paths(fine: DataFrame, coarse: DataFrame, keys: list[str]) -> list[tuple[str, str, bool]]:
    """``(key, path, is_fine)`` of every band, from the first catalogue that has it; a band of neither is a ``ValueError``."""
    one = lambda c: {r.key: r.fpath for r in c.filter(F.col("key").isin(keys)).groupBy("key").agg(F.max("fpath").alias("fpath")).collect()}  # noqa: E731 one row a requested band
    first, second = one(fine), one(coarse)
    if missing := [k for k in keys if k not in first and k not in second]:
        raise ValueError(f"bands {missing} were found in neither catalogue")
    return [(k, first.get(k) or second[k], k in first) for k in keys]


def band_fallback(first: DataFrame, second: DataFrame, group: list[str], bands: list[str]) -> DataFrame:
    """Per group and band the file of the first catalogue, else of the second; null fpath if neither has it."""
    groups = first.select(*group).union(second.select(*group)).distinct()
    wanted = groups.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    one = lambda c, name: c.groupBy(*group, "band").agg(F.min("fpath").alias(name))
    joined = wanted.join(one(first, "p1"), [*group, "band"], "left").join(one(second, "p2"), [*group, "band"], "left")
    return joined.select(*group, "band", F.coalesce("p1", "p2").alias("fpath"), F.when(F.col("p1").isNotNull(), 1).when(F.col("p2").isNotNull(), 2).alias("resolved_in"))


def matching(files: DataFrame, pattern: str, name: str = "fname") -> DataFrame:
    """Files whose name fits a shell wildcard."""
    return files.filter(F.col(name).rlike(wildcard(pattern)))


def pair_quality_masks(files: DataFrame, order: str) -> DataFrame:
    """``(fname, mask)``: every image with its quality mask, the first in listing order.

    ``files`` has fpath, fname and the order column. Images are the analytic and
    panchromatic assets; a mask must be in the same folder, share the info part
    and fit the asset's pattern.
    """
    named = files.withColumns(asset_fields(F.col("fname"))).withColumn("folder", dirname(F.col("fpath")))
    images = named.filter(F.col("asset").isin("analytic", "ortho_panchromatic")).select("folder", "info", "asset", "fname")
    masks = named.filter(F.col("fname").contains("udm2")).select("folder", "info", F.col("fname").alias("mask"), F.col(order).alias("at"))
    analytic = F.col("mask").rlike(wildcard("*ortho_udm2.tif")) | F.col("mask").rlike(wildcard("*[0-9]_udm2.tif"))
    fits = ((F.col("asset") == "analytic") & analytic) | ((F.col("asset") == "ortho_panchromatic") & F.col("mask").rlike(wildcard("*panchromatic_udm2.tif")))
    return images.join(masks, ["folder", "info"]).filter(fits).groupBy("folder", "fname").agg(F.min_by("mask", "at").alias("mask")).select("fname", "mask")


def cloud_cover(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """``(image, cloud_pct)``: share of the greater of two values, in percent.

    An image of zeros only gets 0.1, one of ones only or of more than two values
    gets null. Counts per image and value combine before the shuffle.
    """
    counts = pixels.groupBy(image, value).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(image).agg(F.count(F.lit(1)).alias("kinds"), F.max_by("n", value).alias("high"), F.sum("n").alias("total"), F.max(value).alias("top"))
    share = F.bround(100 * F.col("high") / F.col("total"), 2)
    return whole.select(image, F.when((F.col("kinds") == 1) & (F.col("top") == 0), F.lit(0.1)).when(F.col("kinds") == 2, share).alias("cloud_pct"))


def images_over_points(images: DataFrame, masks: DataFrame, points: DataFrame, flags: DataFrame, threshold: float, cell: float) -> DataFrame:
    """``(fname, cloud_pct, line)`` of the images that hold a point and whose quality mask shows few clouds, with a report line each.

    ``images`` has fname, size_bytes and a box (left, bottom, right, top), ``masks``
    pairs fname with mask, ``points`` has x and y, ``flags`` has mask and value.
    """
    from gridloom.operators.overlap import box_semi

    feet = images.select(F.col("fname").alias("id"), "left", "bottom", "right", "top")
    dots = points.select("x", "y").distinct().select(F.xxhash64("x", "y").alias("id"), F.col("x").alias("left"), F.col("y").alias("bottom"), F.col("x").alias("right"), F.col("y").alias("top"))
    over = box_semi(feet, dots, cell).withColumnRenamed("id", "fname")
    clear = clear_images(cloud_cover(flags, "mask", "value"), threshold)
    found = images.select("fname", "size_bytes").join(over, "fname", "left_semi").join(masks, "fname").join(clear, "mask")
    line = F.format_string("File: %s: Size: %s CloudCoverage: %s", "fname", size_text(F.col("size_bytes")), F.col("cloud_pct").cast("string"))
    return found.select("fname", "cloud_pct", line.alias("line"))


def clear_images(cover: DataFrame, threshold: float) -> DataFrame:
    """Images below the threshold; a share that rounds to 0 drops out, as a null does."""
    return cover.filter((F.col("cloud_pct") < threshold) & (F.col("cloud_pct") != 0))


def pair_by_digits(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Positional pairs of two lists of names, both ordered by the digits they hold."""
    from gridloom.operators.overlap import number_rows

    ranked = lambda df, alias: number_rows(df, key, "pos").select("pos", F.col("fname").alias(alias))
    return ranked(left, "reference").join(ranked(right, "target"), "pos")


