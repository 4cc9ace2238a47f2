"""Clusters of mutually similar vectors by density (problem 4).

Every usable vector with a neighbour within ``eps`` is a core point, so the
clusters are the sets connected by similarity, directly or through others.

1. Vectors are collapsed into cells of a grid so fine that all vectors of a cell
   are within ``eps`` of each other (side ``eps / sqrt(dimensions)``). The
   aggregation combines before it shuffles; however large a group of nearly
   equal vectors, one representative per cell goes on.
2. Representatives are reduced by an orthonormal projection onto their leading
   principal axes. A projection never lengthens distances, so cutting the
   reduced space into boxes with margins of ``eps`` loses no neighbour.
3. Each box is clustered by itself. Two cells whose representatives are within
   ``eps`` are linked. Two cells of which only unseen members might be within
   ``eps`` are noted as doubtful.
4. Box clusters that share a core cell (one of the margin) are merged by
   distributed label propagation. A box that holds too many representatives for
   one task is cut again along the axes that are left, and only if those do not
   divide it clustered in pairs of blocks, which share cells in the same way.
5. Doubtful cell pairs that the merge has not joined anyway are decided by
   their members, first by the closest few, then, of the pairs still apart, by
   all that the extents of both sides leave, in blocks; the merge is carried on
   with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import split_join
from gridloom.session import cut, discard

MASK = 9999.0
#: Axes of the search grid inside a box, and box sides in multiples of eps.
AXES, SIDE = 4, 16.0
#: Vectors that a box should hold on average, and boxes that an axis adds.
BOX_ROWS, BOXES_AN_AXIS = 30_000, 2.2
#: Representatives that one task clusters at most; a fuller box is taken in pairs of blocks.
BOX_LIMIT = 1_000_000
#: Members of a doubtful cell that are compared first, and members that one task compares at once.
CLOSEST, PAIR_BLOCK = 48, 4096
#: Candidate pairs that are expanded at once (8 bytes each, twice).
PAIRS_AT_ONCE = 2_000_000
#: A fine cell with more representatives than this is searched leader by leader.
CROWD = 64


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """``(id, x)`` of the rows with an id and ``dims`` finite values, none the mask.

    Null, short and long vectors, nulls, NaN and infinities make a row
    unusable. Only the two columns are read.
    """
    x = F.col(vector_col)
    fine = F.size(x) == dims
    each = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & (v != MASK))
    return df.select(F.col(id_col).alias("id"), x.cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & fine & each)


def _cell_keys(points: DataFrame, eps: float, dims: int) -> DataFrame:
    """Adds k1, k2: a 128-bit hash of the fine grid cell of x."""
    side = eps / math.sqrt(dims)
    cells = F.transform("x", lambda v: F.floor(v / side))
    return points.withColumn("k1", F.xxhash64(cells)).withColumn("k2", F.xxhash64(cells, F.lit(1)))


def _moments(points: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance; each task sends one row of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = points.select("x").mapInArrow(run, "n double, s array<double>, q array<double>")
    sums = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    row = parts.agg(F.sum("n"), sums("s", dims), sums("q", dims * dims)).first()
    n = int(row[0] or 0)
    if n == 0:
        return 0, np.zeros(dims), np.eye(dims)
    mean = np.array(row[1]) / n
    return n, mean, np.array(row[2]).reshape(dims, dims) / n - np.outer(mean, mean)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)


def find(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component, after adding the links a-b."""
    label = parent
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label


def local_links(x: np.ndarray, z: np.ndarray, crowded: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the representatives of one box, and doubtful pairs.

    ``z`` are the reduced vectors that candidates are found with. Pairs within
    ``eps`` are linked. Members of a crowded cell lie within the cell, at most
    ``eps`` from its representative, so a pair that is not linked anyway is
    doubtful if its cells (a lone vector is a cell of no extent) come within
    ``eps`` of each other.
    """
    everyone, many, lone = np.arange(len(x)), np.flatnonzero(crowded), np.flatnonzero(~crowded)
    label, _ = _search(x, z, np.arange(len(x)), everyone, everyone, eps, eps)
    doubt = []
    if len(many):
        doubt += _search(x, z, label, lone, many, 2 * eps, eps, collect=True)[1]
        doubt += _search(x, z, label, many, many, 3 * eps, eps, collect=True)[1]
    pairs = np.concatenate(doubt) if doubt else np.zeros((0, 2), dtype=np.int64)
    if len(pairs):
        side = eps / math.sqrt(x.shape[1])
        low = np.where(crowded[:, None], np.floor(x / side) * side - 1e-6 * side, x)
        high = np.where(crowded[:, None], low + side * (1 + 2e-6), x)
        i, j = pairs.T
        gap = np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0)
        pairs = pairs[(label[i] != label[j]) & ((gap**2).sum(1) <= eps * eps)]
    return label, pairs


def _search(x, z, label, left, right, radius, eps, collect=False):
    """Join left with right over grid cells of side ``radius``.

    Links pairs within ``eps`` into label, or (``collect``) returns the pairs
    within ``radius`` whose labels differ.
    """
    cells = np.floor(z / radius).astype(np.int64)
    cells -= cells.min(0)
    span = cells.max(0) + 3
    weight = np.ones(z.shape[1], dtype=np.int64)
    for k in range(z.shape[1] - 2, -1, -1):
        weight[k] = weight[k + 1] * span[k + 1]
    code = (cells + 1) @ weight
    left, right = left[np.argsort(code[left], kind="stable")], right[np.argsort(code[right], kind="stable")]
    sorted_code = code[right]
    if not collect:
        label = _crowds(x, right, sorted_code, label, eps)
    out = []
    offsets = np.array(np.meshgrid(*[[-1, 0, 1]] * z.shape[1], indexing="ij")).reshape(z.shape[1], -1).T @ weight
    for shift in offsets if collect else offsets[offsets >= 0]:
        lo, hi = np.searchsorted(sorted_code, code[left] + shift, "left"), np.searchsorted(sorted_code, code[left] + shift, "right")
        count = hi - lo
        hit = np.flatnonzero(count)
        ends = np.cumsum(count[hit])
        at = 0
        while at < len(hit):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
            who = hit[at:to]
            c = count[who]
            i = np.repeat(left[who], c)
            j = right[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[who], c)]
            keep = (label[i] != label[j]) & ((i < j) if not collect and shift == 0 else (i != j))
            i, j = i[keep], j[keep]
            if len(i):
                d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
                near = d <= radius
                if collect:
                    out.append(np.column_stack([i[near], j[near]]))
                else:
                    label = find(label, i[near], j[near])
            at = to
    return label, out


def _crowds(x, order, code, label, eps):
    """Link inside crowded fine cells, leader by leader.

    A leader takes all unvisited within eps, those take theirs, and so on: each
    representative is compared with the unvisited only, which a dense group
    exhausts at once, instead of with all others.
    """
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    size = np.diff(np.r_[start, len(code)])
    for s, c in zip(start[size > CROWD], size[size > CROWD]):
        rest = order[s : s + c]
        while len(rest):
            queue, rest, first = [rest[0]], rest[1:], rest[0]
            members = [first]
            while queue and len(rest):
                p = queue.pop()
                near = ((x[rest] - x[p]) ** 2).sum(1) <= eps * eps
                got = rest[near]
                rest = rest[~near]
                queue += got.tolist()
                members += got.tolist()
            members = np.array(members)
            label = find(label, np.full(len(members) - 1, first), members[1:])
    return label


def components(links: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` of an undirected graph ``(a, b)``, root the smallest node.

    Every round each node takes the smallest root among its neighbours' roots,
    then its root's root (pointer jumping); rounds end when nothing changes.
    Each round is a table in the shared folder, so lineage stays short.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    roots = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{label}-roots")
    last = roots
    while True:
        lowest = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        took = roots.join(lowest, roots.node == lowest.a, "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root"))
        # a root learns the lowest label that any of its members has learnt
        taught = took.groupBy("was").agg(F.min("root").alias("best")).withColumnRenamed("was", "of")
        new = cut(took.join(taught, took.was == taught.of, "left").select("node", "was", F.least("root", F.coalesce("best", "root")).alias("root")), f"{label}-round")
        discard(last)
        last, roots = new, new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            discard(both)
            return roots


def clusters(df: DataFrame, id_col: str, vector_col: str, eps: float, dims: int, min_size: int = 3) -> DataFrame:
    """``(cluster_id, sample_id)`` of all clusters of at least ``min_size`` ids.

    ``cluster_id`` is the smallest id of the cluster. Unusable rows (see
    :func:`usable`) belong to none; an id delivered several times counts once
    (an id with different vectors connects the clusters of all of them); an
    empty table gives an empty one.
    """
    points = _cell_keys(usable(df, id_col, vector_col, dims), eps, dims)
    roots = cell_clusters(points, eps, dims)
    placed = cut(points.select("id", "k1", "k2").join(roots, ["k1", "k2"]).select(F.col("root").alias("cluster_id"), F.col("id").alias("sample_id")).distinct(), "p4-placed")
    sizes = cut(placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "p4-sizes")
    big = sizes.filter(F.col("n") >= min_size).select("cluster_id")
    return split_join(placed, big, "cluster_id", sizes, "sample_id").select("cluster_id", "sample_id")


def cell_clusters(points: DataFrame, eps: float, dims: int) -> DataFrame:
    """``(k1, k2, root)`` of the cells with company: other members or other cells."""
    n, mean, cov = _moments(points, dims)
    axes = np.linalg.eigh(cov)[1][:, ::-1].T.copy()
    cut_axes = min(dims, max(1, math.ceil(math.log(max(n / BOX_ROWS, 1)) / math.log(BOXES_AN_AXIS))))
    side = SIDE * eps
    kind = points.schema["id"].dataType.simpleString()
    cells = points.groupBy("k1", "k2").agg(F.min(F.struct("id", "x")).alias("first"), F.max(F.struct("id", "x")).alias("last"))
    # rows of one id with one vector are no company: crowded is a cell with two different members
    cells = cells.select("k1", "k2", F.col("first.id").alias("id"), (F.col("first") != F.col("last")).alias("many"), F.col("first.x").alias("x"))
    spread = cells = cut(cells, "p4-cells")
    # one-sided margins: a box also holds what lies beyond its upper faces by at most the margin
    margin = F.when(F.col("many"), 3 * eps * (1 + 1e-9)).otherwise(2 * eps * (1 + 1e-9))

    def along(df: DataFrame, k: int, where=None) -> DataFrame:
        """Boxes cut along axis ``k`` (those of the rows ``where``)."""
        z = sum((F.element_at("x", i + 1) - float(mean[i])) * float(axes[k][i]) for i in range(dims)) / side
        w = F.floor("z")
        both = F.when((F.col("z") - w) * side < margin, F.array(w, w - 1)).otherwise(F.array(w))
        both = both if where is None else F.when(where, both).otherwise(F.array(F.lit(None).cast("bigint")))
        return df.withColumn("z", z).withColumn(f"w{k}", F.explode(both)).drop("z")

    for k in range(cut_axes):
        spread = along(spread, k)
    keys = [f"w{k}" for k in range(cut_axes)]
    schema = f"k1 bigint, k2 bigint, id {kind}, a {kind}, doubt boolean, x array<double>"

    def one_box(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x").combine_chunks(), dims)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, many = x[order], ids[order], table.column("many").to_numpy()[order]
        label, pairs = local_links(x, (x - mean) @ axes[:AXES].T, many, eps)
        size = np.bincount(label, minlength=len(x))
        keep = np.flatnonzero((size[label] > 1) | many)
        who = np.concatenate([keep, pairs[:, 0], pairs[:, 1]])
        others = x[np.concatenate([pairs[:, 1], pairs[:, 0]])].tolist()
        return pa.table({
            "k1": table.column("k1").to_numpy()[order][who], "k2": table.column("k2").to_numpy()[order][who], "id": ids[who],
            "a": np.concatenate([ids[label[keep]], ids[pairs[:, 1]], ids[pairs[:, 0]]]), "doubt": np.repeat([False, True], [len(keep), 2 * len(pairs)]),
            "x": pa.array([None] * len(keep) + others, pa.list_(pa.float64())),
        })

    for k in range(cut_axes, dims + 1):
        full = cut(spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BOX_LIMIT), "p4-full")
        if full.isEmpty():
            break
        marked = spread.join(full, [spread[c].eqNullSafe(full[c]) for c in keys], "left").select(spread["*"], full["_n"])
        if k < dims:
            spread, keys = along(marked, k, F.col("_n").isNotNull()).drop("_n"), [*keys, f"w{k}"]
        else:
            spread, keys = _in_blocks(marked, keys)
    local = cut(spread.groupBy(*keys).applyInArrow(one_box, schema), "p4-boxes")
    # shared core cells: a cell that several boxes hold links their labels
    firm = local.filter("not doubt").select("k1", "k2", "id", "a").distinct()
    links = firm.groupBy("id").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.collect_set("a").alias("all")).filter("low <> high")
    edges = links.select("low", F.explode("all").alias("b")).filter("low <> b").select(F.col("low").alias("a"), "b")
    merged = components(edges, "p4-merge") if not edges.isEmpty() else None
    base = firm.groupBy("k1", "k2", "id").agg(F.min("a").alias("a"))
    rooted = base if merged is None else base.join(merged, base.a == merged.node, "left").select("k1", "k2", "id", F.coalesce("root", "a").alias("a"))
    rooted = cut(rooted, "p4-roots")
    return _settle(points, local, rooted, eps, dims)


def _in_blocks(marked: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Splits boxes of more than BOX_LIMIT representatives (``_n``, else null) into pairs of blocks.

    A full box that no cut in space divides (its rows lie within each other's
    margins) is divided by a hash of the id; every two of its blocks meet in one
    group, so every two rows do, and the groups' clusters merge like those of
    boxes.
    """
    blocks = F.coalesce(F.ceil(F.col("_n") * 2 / BOX_LIMIT), F.lit(1)).cast("int")
    split = marked.withColumn("_b", blocks).withColumn("_h", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
    split = split.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    split = split.withColumn("_p", F.least("_h", "_j")).withColumn("_q", F.greatest("_h", "_j")).drop("_n", "_b", "_h", "_j")
    return split, [*keys, "_p", "_q"]


def _settle(points: DataFrame, local: DataFrame, rooted: DataFrame, eps: float, dims: int) -> DataFrame:
    """Decide the doubtful pairs by their members, and join what they link.

    Three steps, each over the pairs still apart after the one before: every
    member against the other cell's representative, which is linear and joins
    dense neighbours; the members nearest the other cell, some ``CLOSEST`` of
    each side; at last all members that can have a partner.
    """
    doubts = local.filter("doubt").select("k1", "k2", "id", F.col("a").alias("other"), F.col("x").alias("ox")).dropDuplicates(["id", "other"])
    every = rooted.select("k1", "k2", "id", "a")
    if doubts.isEmpty():
        return every.select("k1", "k2", F.col("a").alias("root"))
    # lone cells have no root yet; they get their own, so that they can be joined
    lone = doubts.join(every.select("id"), "id", "left_anti").select("k1", "k2", "id", F.col("id").alias("a")).distinct()
    every = cut(every.unionByName(lone), "p4-every")
    side = eps / math.sqrt(dims)
    beyond = F.zip_with("x", "ox", lambda v, o: F.greatest(F.floor(o / side) * side - v, v - (F.floor(o / side) + 1) * side, F.lit(0.0)))
    for step in ("representatives", "closest", "members"):
        roots = every.select("id", F.col("a").alias("r"))
        asked = doubts.join(roots, "id").join(roots.select(F.col("id").alias("other"), F.col("r").alias("s")), "other").filter("r <> s")
        asked = cut(asked.withColumnRenamed("id", "cell"), "p4-asked")
        if asked.isEmpty():
            break
        member = points.join(asked, ["k1", "k2"])
        if step == "representatives":
            links = member.filter(_apart("x", "ox") <= eps * eps).select("r", "s")
        else:
            near = member.withColumn("far", F.aggregate(beyond, F.lit(0.0), lambda t, v: t + v * v)).filter(F.col("far") <= eps * eps * (1 + 1e-9))
            near = near.select("cell", "other", "r", "s", "x", "far").distinct()
            links = _closest(near, eps) if step == "closest" else _by_members(near, eps, dims)
        links = cut(links.distinct().select(F.col("r").alias("a"), F.col("s").alias("b")), "p4-links")
        if not links.isEmpty():
            merged = components(links, "p4-settle")
            every = cut(every.join(merged, every.a == merged.node, "left").select("k1", "k2", "id", F.coalesce("root", "a").alias("a")), "p4-every")
    return every.select("k1", "k2", F.col("a").alias("root"))


def _sides(near: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """Members of the smaller cell of each pair as u, those of the other as v, under one key."""
    left = near.filter("cell < other").select("cell", "other", "r", "s", F.col("x").alias("u"), *also)
    right = near.filter("cell > other").select(F.col("other").alias("cell"), F.col("cell").alias("other"), F.col("x").alias("v"), *also)
    return left, right


def _closest(near: DataFrame, eps: float) -> DataFrame:
    """Links among the members nearest the other cell: one of each of CLOSEST parts, so at most its square of pairs."""
    part = F.pmod(F.xxhash64("x"), F.lit(CLOSEST))
    few = near.groupBy("cell", "other", "r", "s", part.alias("part")).agg(F.min_by("x", F.struct("far", "x")).alias("x"))
    left, right = _sides(few)
    return left.join(right, ["cell", "other"]).filter(_apart("u", "v") <= eps * eps).select("r", "s")


def _by_members(near: DataFrame, eps: float, dims: int) -> DataFrame:
    """Links among all members that can have a partner.

    The extent of one side's members is one row per pair; a member of the other
    side farther than ``eps`` from it is dropped, which leaves nothing of dense
    cells with a gap between them. What is left meets in blocks of bounded size,
    each compared at once.
    """
    for _ in range(2):
        low, high = (F.array(*[f(F.element_at("x", i + 1)) for i in range(dims)]) for f in (F.min, F.max))
        extent = near.groupBy("cell", "other").agg(low.alias("low"), high.alias("high")).select(F.col("other").alias("cell"), F.col("cell").alias("other"), "low", "high")
        gap = F.zip_with("x", F.arrays_zip("low", "high"), lambda v, b: F.greatest(b["low"] - v, v - b["high"], F.lit(0.0)))
        near = cut(near.join(extent, ["cell", "other"]).filter(F.aggregate(gap, F.lit(0.0), lambda t, v: t + v * v) <= eps * eps * (1 + 1e-9)).drop("low", "high"), "p4-near")
    sizes = near.groupBy("cell", "other").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("own"))
    both = sizes.join(sizes.select(F.col("other").alias("cell"), F.col("cell").alias("other"), F.col("own").alias("their")), ["cell", "other"])
    dealt = near.join(both, ["cell", "other"]).withColumn("i", F.pmod(F.xxhash64("x"), F.col("own")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("their") - 1)))
    left, right = _sides(dealt, "i", "j")
    keys = ["cell", "other", "i", "j"]
    kind = near.schema["r"].dataType.simpleString()

    def test(a: pa.Table, b: pa.Table) -> pa.Table:
        hit = False
        if a.num_rows and b.num_rows:
            u, v = _matrix(a.column("u").combine_chunks(), dims), _matrix(b.column("v").combine_chunks(), dims)
            # blocks are of bounded size on average; rows one by one keep the memory so, and stop at the first hit
            hit = any((((v - p) ** 2).sum(1) <= eps * eps).any() for p in u)
        return a.select(["r", "s"]).slice(0, 1 if hit else 0)

    meet = right.withColumnsRenamed({"i": "_", "j": "i"}).withColumnRenamed("_", "j").select(*keys, "v")
    return left.select(*keys, "r", "s", "u").groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInArrow(test, f"r {kind}, s {kind}")


def _apart(u: str, v: str):
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def describe(df: DataFrame, found: DataFrame, id_col: str, vector_col: str, dims: int, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, rank, sample_id, distance)``: the medoids of each cluster.

    The member with the smallest sum of squared distances to all members is the
    one nearest the mean, so medoids need one mean per cluster and no pairs;
    rank 1 is the medoid, ties go to the smaller id. Means combine before the
    shuffle, large clusters are split over several tasks, and the ranking keeps
    only ``typical`` rows of each part before the parts of a cluster meet.
    """
    vectors = usable(df, id_col, vector_col, dims).groupBy("id").agg(F.min("x").alias("x"))
    placed = cut(found.join(vectors, found.sample_id == vectors.id).select("cluster_id", "sample_id", "x"), "p4-vectors")
    means = cut(placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.element_at("x", i + 1)) for i in range(dims)]).alias("mean")), "p4-means")
    near = split_join(placed, means, "cluster_id", means.withColumnRenamed("size", "n"), "sample_id").select("cluster_id", "_salt", "size", "sample_id", F.round(F.sqrt(_apart("x", "mean")), 6).alias("distance"))
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "sample_id"))
    few = near.withColumn("rank", order("cluster_id", "_salt")).filter(F.col("rank") <= typical)
    return few.withColumn("rank", order("cluster_id")).filter(F.col("rank") <= typical).select("cluster_id", "size", "rank", "sample_id", "distance")
