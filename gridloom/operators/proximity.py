"""Points near other points, and the regions that contain them (problem 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import parse_polygon, point_of, triangulate
from gridloom.session import cut

#: Triangles that one hierarchy holds at most (48 bytes each, 10 MB), and points that one task tests against one.
BLOCK_TRIANGLES, BLOCK_POINTS = 200_000, 1_000_000
#: Grid cells that share one hierarchy's worth of triangles.
CELLS_A_BLOCK = 8
TRIANGLE = ["ax", "ay", "bx", "by", "cx", "cy"]
LEAF = 8


def read_points(df: DataFrame, id_col: str, geometry_col: str) -> DataFrame:
    """Distinct ``(id, x, y)`` of the rows whose geometry states a point.

    Rows with a null id or no readable point are left out; a point delivered
    several times at one place counts once.
    """
    # the aggregation stands between parsing and filter, so that the texts are parsed once
    places = df.filter(F.col(id_col).isNotNull() & F.col(geometry_col).isNotNull()).select(F.col(id_col).alias("id"), point_of(F.col(geometry_col)).alias("p")).distinct()
    return places.select("id", "p.x", "p.y").filter("x is not null and y is not null")


def near_pairs(points: DataFrame, distance: float) -> DataFrame:
    """``(first_id, second_id)`` of different ids at most ``distance`` apart, the smaller first.

    ``points`` has id, x and y. Square cells of four distances; a point is
    copied only into those forward neighbour cells that it could reach, so each
    pair meets in exactly one cell and about a quarter of the points are
    copied. An equi-join on the cell, which AQE splits where a cell is hot.
    Points at one place are pairs; a point is never its own pair.
    """
    size, d = 4.0 * distance, float(distance)
    home = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    right = F.col("x") >= (F.col("cx") + 1) * size - d
    up = F.col("y") >= (F.col("cy") + 1) * size - d
    down = F.col("y") < F.col("cy") * size + d
    step = lambda ok, dx, dy: F.when(ok, F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")))
    steps = F.filter(F.array(step(F.lit(True), 0, 0), step(right, 1, 0), step(up, 0, 1), step(right & up, 1, 1), step(right & down, 1, -1)), lambda s: s.isNotNull())
    left = home.select("id", "x", "y", "cx", "cy", F.explode(steps).alias("s")).select(
        F.col("id").alias("i"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own")
    )
    apart = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    met = left.join(home, ["cx", "cy"]).filter(F.when(F.col("own"), F.col("i") < F.col("id")).otherwise(F.col("i") != F.col("id")) & (apart <= d * d))
    return met.select(F.least("i", "id").alias("first_id"), F.greatest("i", "id").alias("second_id")).distinct()


def triangles_of(polys: DataFrame, id_col: str, geometry_col: str) -> DataFrame:
    """``(poly, ax, ay, bx, by, cx, cy)``: triangles that cover each region.

    Regions without readable geometry give no triangle; an id given on several
    rows is the union of its shapes.
    """
    kind = polys.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is None:
                    continue
                for piece in parse_polygon(text):
                    for t in triangulate(piece):
                        ids.append(key)
                        rows.append([c for v in t for c in v])
            flat = np.array(rows, dtype=float).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(flat[:, k]) for k in range(6))], names=["poly", *TRIANGLE])

    return polys.select(id_col, geometry_col).mapInArrow(run, f"poly {kind}, ax double, ay double, bx double, by double, cx double, cy double")


class TriangleTree:
    """A bounding-volume hierarchy over triangles, queried with arrays of points."""

    def __init__(self, tri: np.ndarray):
        self.tri = tri
        self.lo, self.hi = tri.reshape(-1, 3, 2).min(1), tri.reshape(-1, 3, 2).max(1)
        self.nodes: list[tuple] = []
        if len(tri):
            self._build(np.arange(len(tri)))

    def _build(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        lo, hi = self.lo[members].min(0), self.hi[members].max(0)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = (lo, hi, members, 0, 0)
        else:
            axis = int(np.argmax(hi - lo))
            order = members[np.argsort(self.lo[members, axis] + self.hi[members, axis], kind="stable")]
            half = len(order) // 2
            a, b = self._build(order[:half]), self._build(order[half:])
            self.nodes[at] = (lo, hi, None, a, b)
        return at

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point positions and triangle positions of all containments."""
        points, triangles, stack = [], [], [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            node, who = stack.pop()
            lo, hi, members, a, b = self.nodes[node]
            px, py = x[who], y[who]
            who = who[(px >= lo[0]) & (px <= hi[0]) & (py >= lo[1]) & (py <= hi[1])]
            if not len(who):
                continue
            if members is None:
                stack += [(a, who), (b, who)]
            else:
                inside = _in_triangles(x[who], y[who], self.tri[members])
                p, t = np.nonzero(inside)
                points.append(who[p])
                triangles.append(members[t])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(points), np.concatenate(triangles)) if points else (none, none)


def _in_triangles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """points x triangles: inside or on the border.

    Each edge is computed from its lexicographically smaller end, so that two
    triangles that share an edge see values of opposite sign: no point falls
    between them.
    """
    inside = np.ones((len(x), len(tri)), dtype=bool)
    for p, q in ((0, 2), (2, 4), (4, 0)):
        ax, ay, bx, by = tri[:, p], tri[:, p + 1], tri[:, q], tri[:, q + 1]
        turned = (ax > bx) | ((ax == bx) & (ay > by))
        sx, sy, ex, ey = np.where(turned, bx, ax), np.where(turned, by, ay), np.where(turned, ax, bx), np.where(turned, ay, by)
        side = (ex - sx) * (y[:, None] - sy) - (ey - sy) * (x[:, None] - sx)
        inside &= np.where(turned, side <= 0, side >= 0)
    return inside


def inside_regions(points: DataFrame, triangles: DataFrame, block: int = BLOCK_TRIANGLES) -> DataFrame:
    """``(id, poly)``: every region that holds each point, once.

    The triangles are written once and counted. At most ``block`` of them are
    sent to the executors as one hierarchy, which no point has to be shuffled
    for. More are distributed: triangles and points go to the cells of a grid,
    and every cell builds the hierarchy of its own triangles, so the points are
    scanned once however many triangles there are. A point on a border shared by
    triangles, pieces or regions belongs to each region once.
    """
    triangles = cut(triangles, "triangles")
    kind, poly = points.schema["id"].dataType.simpleString(), triangles.schema["poly"].dataType.simpleString()
    ends = [end for k in "xy" for end in (F.min(F.least(f"a{k}", f"b{k}", f"c{k}")), F.max(F.greatest(f"a{k}", f"b{k}", f"c{k}")))]
    box = triangles.agg(F.count(F.lit(1)), *ends).first()
    total, left, right, bottom, top = box
    if not total:
        return points.sparkSession.createDataFrame([], f"id {kind}, poly {poly}")
    near = points.select("id", "x", "y").filter(F.col("x").between(left, right) & F.col("y").between(bottom, top))
    if total <= block:
        chunk = triangles.toArrow()  # at most ``block`` rows
        tri = np.column_stack([chunk.column(c).to_numpy() for c in TRIANGLE])
        sent = points.sparkSession.sparkContext.broadcast((tri, chunk.column("poly").to_numpy()))
        return near.mapInArrow(_tester(sent), f"id {kind}, poly {poly}").distinct()
    across = math.ceil(math.sqrt(CELLS_A_BLOCK * total / block))
    return _inside_by_cells(near, triangles, (left, bottom), ((right - left) / across or 1.0, (top - bottom) / across or 1.0), across, block, f"id {kind}, poly {poly}").distinct()


def _inside_by_cells(points: DataFrame, triangles: DataFrame, origin: tuple, side: tuple, across: int, block: int, schema: str) -> DataFrame:
    """Points and triangles meet in the cells of a grid of ``across`` squared cells.

    A triangle goes to every cell that its bounding box covers. The triangles of
    a crowded cell are dealt to several hierarchies, its points to several tasks,
    so that neither a hot place nor a hot region is gathered in one task.
    """
    at = lambda c, k: F.greatest(F.least(F.floor((c - origin[k]) / side[k]), F.lit(across - 1)), F.lit(0)).cast("int")
    span = lambda k: F.sequence(at(F.least(*[v + "xy"[k] for v in "abc"]), k), at(F.greatest(*[v + "xy"[k] for v in "abc"]), k))
    spread = triangles.withColumn("gx", F.explode(span(0))).withColumn("gy", F.explode(span(1)))
    placed = points.withColumns({"gx": at(F.col("x"), 0), "gy": at(F.col("y"), 1)})
    # at most across squared rows
    count = lambda df, name: df.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias(name))
    shares = cut(count(spread, "nt").join(count(placed, "np"), ["gx", "gy"]).select("gx", "gy", F.ceil(F.col("nt") / block).cast("int").alias("t"), F.ceil(F.col("np") / BLOCK_POINTS).cast("int").alias("p")), "cells")
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["gx", "gy", "ti", "pi"]
    left = placed.join(shares, ["gx", "gy"]).withColumn("pi", own("p", "id")).withColumn("ti", each("t")).select(*keys, "id", "x", "y")
    right = spread.join(shares, ["gx", "gy"]).withColumn("ti", own("t", "poly", *TRIANGLE)).withColumn("pi", each("p")).select(*keys, "poly", *TRIANGLE)

    def test(dots: pa.Table, shapes: pa.Table) -> pa.Table:
        tri = np.column_stack([shapes.column(c).to_numpy() for c in TRIANGLE]) if shapes.num_rows else np.zeros((0, 6))
        p, t = TriangleTree(tri).hits(dots.column("x").to_numpy(), dots.column("y").to_numpy())
        return pa.table({"id": dots.column("id").take(pa.array(p)), "poly": shapes.column("poly").take(pa.array(t))})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(test, schema)


def _tester(sent):
    trees: list[TriangleTree] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri, polys = sent.value
        if not trees:
            trees.append(TriangleTree(tri))
        for batch in batches:
            p, t = trees[0].hits(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p)), pa.array(polys[t])], names=["id", "poly"])

    return run
