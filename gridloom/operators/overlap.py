"""Overlaps of footprints, joined by coarse cells instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.names import output_name
from gridloom.operators.grid import boxes_meet, with_bounds

#: Rows and columns of the blocks on which pixels and windows are joined.
WINDOW_BLOCK = 128


def _celled(boxes: DataFrame, size: float, prefix: str) -> DataFrame:
    """One row per coarse cell that a box covers."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    out = boxes.filter("left <= right and bottom <= top").withColumn("gx", F.explode(span("left", "right"))).withColumn("gy", F.explode(span("bottom", "top")))
    return out.select("gx", "gy", *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "left", "bottom", "right", "top")])


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """``(a_*, b_*)`` of all boxes (id, left, bottom, right, top) that meet; touching counts.

    Boxes are spread over the coarse cells they cover and joined on the cell, an
    equi-join that shuffles and splits like any other. A pair that shares
    several cells is kept only in the one with the lower left corner of its
    intersection, so no distinct is needed. ``cell`` should be about the size of
    a box. Boxes with null or reversed bounds meet none.
    """
    a, b = _celled(left, cell, "a"), _celled(right, cell, "b")
    meet = boxes_meet(*[F.col(f"a_{c}") for c in ("left", "bottom", "right", "top")], *[F.col(f"b_{c}") for c in ("left", "bottom", "right", "top")])
    home = (F.col("gx") == F.floor(F.greatest("a_left", "b_left") / cell)) & (F.col("gy") == F.floor(F.greatest("a_bottom", "b_bottom") / cell))
    return a.join(b, ["gx", "gy"]).filter(meet & home).drop("gx", "gy")


def box_semi(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """``(id,)`` of the left boxes that meet at least one right box; no pair is made.

    A semi-join on the coarse cells: a box leaves at most one row per cell that
    it covers, however many boxes it meets there.
    """
    a, b = _celled(left, cell, "a"), _celled(right, cell, "b")
    meet = boxes_meet(*[F.col(f"a_{c}") for c in ("left", "bottom", "right", "top")], *[F.col(f"b_{c}") for c in ("left", "bottom", "right", "top")])
    return a.join(b, (a.gx == b.gx) & (a.gy == b.gy) & meet, "left_semi").select(F.col("a_id").alias("id")).distinct()


def with_intersection(pairs: DataFrame) -> DataFrame:
    """Adds the common box; it has no area where the boxes only touch."""
    return pairs.withColumns({
        "left": F.greatest("a_left", "b_left"), "bottom": F.greatest("a_bottom", "b_bottom"),
        "right": F.least("a_right", "b_right"), "top": F.least("a_top", "b_top"),
    })


def pairwise_overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """``(poly_id, left, bottom, right, top)``: distinct overlaps, each pair of boxes once.

    Numbered from 1 in the order in which the pairs (smaller id first) come.
    The numbering sorts one row per distinct overlap: partition-wise ranks plus
    the counts of the partitions before.
    """
    pairs = with_intersection(box_pairs(boxes, boxes, cell).filter("a_id < b_id"))
    box = ["left", "bottom", "right", "top"]
    first = pairs.groupBy(*box).agg(F.min(F.struct("a_id", "b_id")).alias("first"))
    return number_rows(first, "first", "poly_id").select("poly_id", *box)


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of a column, without gathering the rows.

    One range partitioning sorts them; the position within a partition is part
    of the running id, and of the rows before a partition only the counts, one
    per partition, meet in one place.
    """
    from gridloom.session import cut

    ranged = cut(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "numbering")
    part, rank = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return ranged.withColumn("_part", part).join(before, "_part").withColumn(name, rank + F.col("_before")).drop("_part", "_id", "_before")


def reference_overlaps(boxes: DataFrame, reference, cell: float) -> DataFrame:
    """``(id, left, bottom, right, top)``: the common box of one reference with every other box it meets."""
    one, others = boxes.filter(F.col("id") == reference), boxes.filter(F.col("id") != reference)
    return with_intersection(box_pairs(one, others, cell)).select(F.col("b_id").alias("id"), "left", "bottom", "right", "top")


def clip_boxes(pixels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(raster_id, poly_id, height, width, c, f, pixel columns...)``: each raster clipped to each box wanted of it.

    ``wanted`` has raster_id, poly_id, left, bottom, right, top and the raster's
    own a, e, c, f, rows and cols. A box is rounded outward to a window and cut
    to the raster; one without a common pixel gives no rows. Rows and columns
    count from the window's corner, and only pixels whose centre lies in the box
    are there. Windows and pixels are joined on the raster's blocks, so a large
    raster is no single key.
    """
    col = lambda x, f: f((F.col(x) - F.col("c")) / F.col("a")).cast("long")
    row = lambda y, f: f((F.col(y) - F.col("f")) / F.col("e")).cast("long")
    zero = F.lit(0).cast("long")
    windows = wanted.withColumns({"_c0": F.greatest(col("left", F.floor), zero), "_c1": F.least(col("right", F.ceil), F.col("cols")), "_r0": F.greatest(row("top", F.floor), zero), "_r1": F.least(row("bottom", F.ceil), F.col("rows"))}).filter("_c1 > _c0 and _r1 > _r0")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / WINDOW_BLOCK), F.floor((F.col(hi) - 1) / WINDOW_BLOCK)))
    spread = windows.withColumn("_br", span("_r0", "_r1")).withColumn("_bc", span("_c0", "_c1"))
    keyed = pixels.withColumns({"_br": F.floor(F.col("row_idx") / WINDOW_BLOCK), "_bc": F.floor(F.col("col_idx") / WINDOW_BLOCK)})
    x, y = F.col("c") + (F.col("col_idx") + 0.5) * F.col("a"), F.col("f") + (F.col("row_idx") + 0.5) * F.col("e")
    inside = (F.col("row_idx") >= F.col("_r0")) & (F.col("row_idx") < F.col("_r1")) & (F.col("col_idx") >= F.col("_c0")) & (F.col("col_idx") < F.col("_c1")) & x.between(F.col("left"), F.col("right")) & y.between(F.col("bottom"), F.col("top"))
    met = keyed.join(spread, ["raster_id", "_br", "_bc"]).filter(inside)
    rest = [c for c in pixels.columns if c not in ("raster_id", "row_idx", "col_idx")]
    return met.select("raster_id", "poly_id", (F.col("_r1") - F.col("_r0")).cast("int").alias("height"), (F.col("_c1") - F.col("_c0")).cast("int").alias("width"), (F.col("c") + F.col("_c0") * F.col("a")).alias("c"), (F.col("f") + F.col("_r0") * F.col("e")).alias("f"), (F.col("row_idx") - F.col("_r0")).alias("row_idx"), (F.col("col_idx") - F.col("_c0")).alias("col_idx"), *rest)


def _own_grid(grids: DataFrame) -> DataFrame:
    return grids.select("raster_id", "a", "e", "c", "f", F.col("height").alias("rows"), F.col("width").alias("cols"))


def clip_overlaps(pixels: DataFrame, grids: DataFrame, cell: float) -> DataFrame:
    """Every raster clipped to every distinct overlap of two rasters, with the name of its file (see :func:`clip_boxes`)."""
    feet = with_bounds(grids).select(F.col("raster_id").alias("id"), "left", "bottom", "right", "top")
    polys = pairwise_overlaps(feet, cell)
    met = box_pairs(feet, polys.withColumnRenamed("poly_id", "id"), cell)
    wanted = met.select(F.col("a_id").alias("raster_id"), F.col("b_id").alias("poly_id"), *[F.col(f"b_{c}").alias(c) for c in ("left", "bottom", "right", "top")])
    return clip_boxes(pixels, wanted.join(_own_grid(grids), "raster_id")).withColumn("name", output_name("overlap", poly=F.col("poly_id"), height=F.col("height"), width=F.col("width")))


def clip_reference(pixels: DataFrame, grids: DataFrame, reference: str, cell: float) -> DataFrame:
    """The areas that a reference raster shares with each other one, clipped from both, with the names of the files.

    ``poly_id`` counts the other rasters in the order of their ids, from 1.
    """
    feet = with_bounds(grids).select(F.col("raster_id").alias("id"), "left", "bottom", "right", "top")
    shared = reference_overlaps(feet, reference, cell)
    order = number_rows(grids.filter(F.col("raster_id") != reference).select(F.col("raster_id").alias("id")), "id", "poly_id").select("id", F.col("poly_id"))
    numbered = shared.join(order, "id")
    both = numbered.select(F.explode(F.array("id", F.lit(reference))).alias("raster_id"), "poly_id", "left", "bottom", "right", "top")
    return clip_boxes(pixels, both.join(_own_grid(grids), "raster_id")).withColumn("name", output_name("tile_overlap", poly=F.col("poly_id"), tile=F.split_part("raster_id", F.lit("_"), F.lit(1))))


def cells_in_regions(pixels: DataFrame, regions: DataFrame, id_col: str, geometry_col: str, transform: tuple[float, float, float, float]) -> DataFrame:
    """``(region, pixel columns...)`` of the pixels whose centre lies in a region of any shape; a pixel in several appears with each."""
    from gridloom.operators.grid import centre_of
    from gridloom.operators.proximity import inside_regions, triangles_of

    x, y = centre_of(F.col("row_idx"), F.col("col_idx"), *transform)
    cell = F.struct("row_idx", "col_idx")
    found = inside_regions(pixels.select(cell.alias("id"), x.alias("x"), y.alias("y")), triangles_of(regions, id_col, geometry_col))
    return found.select(F.col("poly").alias("region"), "id.row_idx", "id.col_idx").join(pixels, ["row_idx", "col_idx"])


def cells_in_boxes(pixels: DataFrame, boxes: DataFrame, block: int) -> DataFrame:
    """``(box id, pixel columns...)`` of the pixels whose centre lies in a box.

    Boxes (id, left, bottom, right, top, in pixel units with rows growing
    downward from 0) are spread over the blocks they cover and joined with the
    pixels on the block. A pixel in several boxes appears with each.
    """
    rows = F.sequence(F.floor(-F.col("top") / block), F.floor(-F.col("bottom") / block))
    cols = F.sequence(F.floor(F.col("left") / block), F.floor(F.col("right") / block))
    spread = boxes.withColumnRenamed("id", "box").withColumn("_br", F.explode(rows)).withColumn("_bc", F.explode(cols))
    keyed = pixels.withColumn("_br", F.floor(F.col("row_idx") / block)).withColumn("_bc", F.floor(F.col("col_idx") / block))
    x, y = F.col("col_idx") + 0.5, -(F.col("row_idx") + 0.5)
    inside = x.between(F.col("left"), F.col("right")) & y.between(F.col("bottom"), F.col("top"))
    return keyed.join(spread, ["_br", "_bc"]).filter(inside).drop("_br", "_bc", "left", "bottom", "right", "top")
