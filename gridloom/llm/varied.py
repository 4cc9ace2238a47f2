"""A varied subset of given size by a cluster-feature tree (problem 1).

Each task condenses its distinct vectors into a tree of cluster features (count,
sum and sum of squares); a leaf entry absorbs a feature whose members lie within
a threshold of its centre in the root mean square, which distance and sum of
squares tell, and the threshold grows when a task holds more entries than its
bound. Partition summaries are entries again and merge the same way. The final
entries are agglomerated by Ward linkage within their class and all merges, over
all classes, are cut at ``size`` groups; the record nearest each group's centre
is the subset. An entry counts once however many records it stands for, so a
large group of nearly equal records gives one member and a rare kind one too.

Which task condenses a vector, and the order in which vectors and summaries are
inserted, follow from their content, so the rows may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, discard

#: Leaf entries of a class in one task, of a class in the end, and of a node.
TASK_ENTRIES, FINAL_ENTRIES, BRANCHING = 1024, 2048, 48
#: Features that are inserted at once.
STEP = 1024
#: Group centres that one broadcast carries at about the most; more become more blocks.
BLOCK_GROUPS = 100_000
#: Partial summaries that one merging task takes.
FAN_IN = 16

_ENTRY = "class string, task int, n double, ss double, ls array<double>"


class FeatureTree:
    """Cluster features of one class in a tree of two levels."""

    def __init__(self, dims: int, bound: int):
        self.dims, self.bound, self.threshold = dims, bound, 0.0
        self.n, self.ss, self.ls = np.zeros(0), np.zeros(0), np.zeros((0, dims))
        self.centre, self.node = np.zeros((0, dims)), np.zeros(0, dtype=np.int64)
        self.nodes = np.zeros((0, dims))

    def insert(self, x: np.ndarray, n: np.ndarray, ss: np.ndarray, ls: np.ndarray) -> None:
        """Insert features with centres ``x``; a plain vector has n 1 and ls x."""
        for at in range(0, len(x), STEP):
            part = slice(at, at + STEP)
            self._insert(x[part], n[part], ss[part], ls[part])
            while len(self.n) > self.bound:
                self._rebuild()

    def _insert(self, x, n, ss, ls) -> None:
        bound = self.threshold**2
        # mean square of the members' distance from their own centre, exact zeros for single vectors
        own = np.where(n > 1, np.maximum(ss / n - (x**2).sum(1), 0), 0)
        near, apart = self._descend(x)
        fits = apart + own <= bound + 1e-9
        self._absorb(near[fits], n[fits], ss[fits], ls[fits])
        rest = np.flatnonzero(~fits)
        if not len(rest):
            return
        fresh, owner = _leaders(x[rest], own[rest], bound)
        base = len(self.n)
        self._grow(x[rest[fresh]])
        self._absorb(base + owner, n[rest], ss[rest], ls[rest])

    def _descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry by way of the nearest node, and its squared distance."""
        near, apart = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        if not len(self.n):
            return near, apart
        to = _square(x, self.nodes).argmin(1)
        for node in np.unique(to):
            who, own = np.flatnonzero(to == node), np.flatnonzero(self.node == node)
            if not len(own):
                continue
            d = _square(x[who], self.centre[own])
            k = d.argmin(1)
            near[who] = own[k]
            apart[who] = ((x[who] - self.centre[own[k]]) ** 2).sum(1)
        return near, apart

    def _absorb(self, at, n, ss, ls) -> None:
        np.add.at(self.n, at, n)
        np.add.at(self.ss, at, ss)
        np.add.at(self.ls, at, ls)
        hit = np.unique(at)
        self.centre[hit] = self.ls[hit] / self.n[hit, None]

    def _grow(self, centres: np.ndarray) -> None:
        k = len(centres)
        self.n, self.ss = np.r_[self.n, np.zeros(k)], np.r_[self.ss, np.zeros(k)]
        self.ls, self.centre = np.vstack([self.ls, np.zeros((k, self.dims))]), np.vstack([self.centre, centres])
        if not len(self.nodes):
            self.nodes = centres[:1].copy()
        self.node = np.r_[self.node, _square(centres, self.nodes).argmin(1)]
        crowded = [i for i, c in enumerate(np.bincount(self.node, minlength=len(self.nodes))) if c > BRANCHING]
        while crowded:  # a full node splits between its two outermost entries
            i = crowded.pop()
            own = np.flatnonzero(self.node == i)
            a = own[((self.centre[own] - self.nodes[i]) ** 2).sum(1).argmax()]
            b = own[((self.centre[own] - self.centre[a]) ** 2).sum(1).argmax()]
            to_b = ((self.centre[own] - self.centre[b]) ** 2).sum(1) < ((self.centre[own] - self.centre[a]) ** 2).sum(1)
            if not to_b.any():
                continue
            self.node[own[to_b]] = len(self.nodes)
            self.nodes = np.vstack([self.nodes, self.centre[own[to_b]].mean(0)])
            self.nodes[i] = self.centre[own[~to_b]].mean(0)
            crowded += [j for j, c in ((i, (~to_b).sum()), (len(self.nodes) - 1, to_b.sum())) if c > BRANCHING]

    def _rebuild(self) -> None:
        """A larger threshold, and all entries inserted anew."""
        some = self.centre[:: max(1, len(self.centre) // 512)]
        d = _square(some, self.centre)
        d[d <= self.threshold**2] = np.inf
        nearest = np.sqrt(np.maximum(d.min(1), 0))
        nearest = nearest[np.isfinite(nearest)]
        step = float(np.median(nearest)) if len(nearest) else 0.0
        self.threshold = max(1.5 * self.threshold, step, 1e-9)
        order = np.argsort(-self.n, kind="stable")
        old = (self.centre[order], self.n[order], self.ss[order], self.ls[order])
        threshold = self.threshold
        self.__init__(self.dims, self.bound)
        self.threshold = threshold
        for at in range(0, len(old[0]), STEP):
            self._insert(*(o[at : at + STEP] for o in old))


def _leaders(x: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaders among features that no entry takes, in order, and the leader that each one joins."""
    if bound == 0:
        order = np.lexsort(x.T)
        new = np.r_[True, (np.diff(x[order], axis=0) != 0).any(1)]
        group = np.empty(len(x), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.full(group.max() + 1, len(x))
        np.minimum.at(first, group, np.arange(len(x)))
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        return np.sort(first), rank[group]
    close = _square(x, x) + own[None] <= bound
    fresh, owner = [], np.full(len(x), -1)
    for i in range(len(x)):
        if owner[i] < 0:
            owner[close[i] & (owner < 0)] = len(fresh)
            owner[i] = len(fresh)
            fresh.append(i)
    return np.array(fresh), owner


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None]


def ward(centres: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges ``(height, a, b)`` of Ward linkage by chains of nearest neighbours.

    Every centre weighs one. ``b`` joins the cluster that ``a`` names; heights
    rise along the tree, so that cutting at a height is cutting the tree.
    """
    m = len(centres)
    d = _square(centres, centres) / 2
    np.fill_diagonal(d, np.inf)
    size, alive, out, chain = np.ones(m), np.ones(m, dtype=bool), [], []
    while len(out) < m - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        h, na, nb = float(d[a, b]), size[a], size[b]
        out.append((max(h, 0.0), min(a, b), max(a, b)))
        keep, gone = min(a, b), max(a, b)
        others = alive.copy()
        others[[a, b]] = False
        nk = size[others]
        row = ((na + nk) * d[a, others] + (nb + nk) * d[b, others] - nk * h) / (na + nb + nk)
        alive[gone] = False
        size[keep] = na + nb
        d[keep, :] = np.inf
        d[keep, others] = row
        d[others, keep] = row
        d[gone, :] = d[:, gone] = np.inf
    return out


def last_merge(trees: DataFrame, size: int) -> tuple | None:
    """``(height, class, named, a, b)`` of the lowest merge that is left out if ``size`` groups are kept; None if there is none.

    All merges of all classes are carried out from the lowest on until ``size``
    groups are left; entries of different classes never merge, so with fewer
    places than classes every class still keeps one group. The merges left out
    are the highest ones, as many as there are places beyond one a class.
    """
    spare = size - trees.select("class").distinct().count()
    if spare <= 0:
        return None
    order = [F.col("h"), F.coalesce("class", F.lit("None")), F.col("class").isNotNull(), F.col("a"), F.col("b")]
    named = trees.filter("h < double('inf')").select(*(c.alias(f"k{k}") for k, c in enumerate(order)))
    highest = named.orderBy(*(F.desc(c) for c in named.columns)).limit(spare)
    low = highest.agg(F.min(F.struct(*named.columns)).alias("m")).first().m
    return tuple(low) if low is not None else None


def cut_class(table: pa.Table, low: tuple | None) -> np.ndarray:
    """Centres of the groups of one class, whose tree is cut below the merge ``low``."""
    table = table.sort_by("i")
    key = table.column("class")[0].as_py()
    centres, label = np.array(table.column("centre").to_pylist()), np.arange(table.num_rows)
    steps = sorted(x for x in zip(*(table.column(c).to_pylist() for c in ("h", "a", "b"))) if x[0] < float("inf"))
    for h, a, b in steps:
        if low is not None and (h, str(key), key is not None, a, b) >= low:
            break
        first, second = sorted((label[a], label[b]))
        label[label == second] = first
    return np.array([centres[label == g].mean(0) for g in np.unique(label)])


def _by_class(classes: np.ndarray) -> dict:
    """Positions of each class."""
    at: dict = {}
    for i, key in enumerate(classes.tolist()):
        at.setdefault(key, []).append(i)
    return {key: np.array(at[key]) for key in sorted(at, key=str)}


def _vectors(table: pa.Table, name: str, dims: int) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)


def _merged(table: pa.Table, dims: int, bound: int) -> FeatureTree:
    """The tree over a table of entries, inserted in the order of their content."""
    n, ss, ls = table.column("n").to_numpy(), table.column("ss").to_numpy(), _vectors(table, "ls", dims)
    order = np.lexsort((ss, *ls.T[::-1], -n))
    n, ss, ls = n[order], ss[order], ls[order]
    tree = FeatureTree(dims, bound)
    tree.insert(ls / n[:, None], n, ss, ls)
    return tree


def _entries(key: str | None, task: int, tree: FeatureTree) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tree.n) + 1, dtype=np.int32) * tree.dims), pa.array(tree.ls.ravel()))
    return pa.table({"class": pa.array([key] * len(tree.n), pa.string()), "task": pa.array(np.full(len(tree.n), task, dtype=np.int32)), "n": pa.array(tree.n), "ss": pa.array(tree.ss), "ls": lists})


def varied_subset(df: DataFrame, id_col: str, vector: Column, class_of: Column, dims: int, size: int) -> DataFrame:
    """``(id, class, group_size, distance)``: at most ``size`` records, one per group.

    ``group_size`` counts the records nearest the group's centre. Rows with a
    null id, or without ``dims`` finite values, cannot be placed and are left
    out; a null class is a class of its own; repeated rows count once in the
    result (ties go to the smallest id). Fewer kinds of records than ``size``
    give fewer rows, an empty table none; if there are more classes than
    ``size`` every class still keeps one.

    Equal vectors are counted before anything is condensed, so no group of
    copies meets in one task. The distinct vectors of a class are dealt to tasks
    by a hash, and bounded summaries are shuffled from there on; one more pass
    finds the nearest records and shuffles one row per task and group. A size
    that one linkage per class could not give splits the classes by quantiles
    of the widest axis into parts with a linkage of their own.
    """
    fine = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("x"), class_of.cast("string").alias("class"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("x") == dims) & fine)
    parts = -(-size // FINAL_ENTRIES)
    if parts > 1:
        rows = _in_parts(rows, dims, parts)

    def condense(table: pa.Table) -> pa.Table:
        x, n = _vectors(table, "x", dims), table.column("n").to_numpy().astype(float)
        order = np.lexsort((*x.T[::-1], table.column("h").to_numpy()))  # by hash: like a random order, but always the same
        x, n = x[order], n[order]
        tree = FeatureTree(dims, TASK_ENTRIES)
        tree.insert(x, n, n * (x**2).sum(1), x * n[:, None])
        return _entries(table.column("class")[0].as_py(), table.column("task")[0].as_py(), tree)

    def merge(table: pa.Table) -> pa.Table:
        return _entries(table.column("class")[0].as_py(), table.column("up")[0].as_py(), _merged(table, dims, FINAL_ENTRIES))

    tasks = max(df.select(id_col).rdd.getNumPartitions(), 1)
    distinct = rows.groupBy("class", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("x")).withColumn("task", F.pmod("h", F.lit(tasks)).cast("int"))
    entries = distinct.groupBy("class", "task").applyInArrow(condense, _ENTRY)
    while tasks > 1:  # a tree of merges, each over at most FAN_IN summaries of a class
        tasks = -(-tasks // FAN_IN)
        entries = entries.withColumn("up", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("class", "up").applyInArrow(merge, _ENTRY)

    def tree(table: pa.Table) -> pa.Table:
        centre = _merged(table, dims, FINAL_ENTRIES).centre
        steps = [*ward(centre), (float("inf"), 0, 0)]
        return pa.table({
            "class": pa.array([table.column("class")[0].as_py()] * len(centre), pa.string()), "i": pa.array(np.arange(len(centre), dtype=np.int32)), "centre": pa.array(centre.tolist(), pa.list_(pa.float64())),
            "h": pa.array([s[0] for s in steps]), "a": pa.array([s[1] for s in steps], pa.int32()), "b": pa.array([s[2] for s in steps], pa.int32()),
        })

    # one tree per class, side by side; all are cut at one height, so no task needs to know another's
    trees = cut(entries.groupBy("class").applyInArrow(tree, "class string, i int, centre array<double>, h double, a int, b int"), "p1-trees")
    low = last_merge(trees, size)

    def groups_of(table: pa.Table) -> pa.Table:
        centres = cut_class(table, low)
        return pa.table({"class": pa.array([table.column("class")[0].as_py()] * len(centres), pa.string()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    groups = cut(trees.groupBy("class").applyInArrow(groups_of, "class string, centre array<double>"), "p1-groups")
    discard(trees)
    total = groups.count()
    blocks = 1 if total <= BLOCK_GROUPS else -(-2 * total // BLOCK_GROUPS)  # whole classes, dealt by hash
    near = None
    for block in range(blocks):
        one = _nearest(rows, groups.filter(F.pmod(F.xxhash64("class"), F.lit(blocks)) == block), block, dims, df.schema[id_col].dataType)
        near = one if near is None else near.unionByName(one)
    discard(groups)
    one = near.groupBy("block", "g").agg(F.sum("n").alias("group_size"), F.min(F.struct("distance", "id", "class")).alias("m"))
    own = F.col("m.class") if parts == 1 else _without_part(F.col("m.class"))
    picked = one.select(F.col("m.id").alias("id"), own.alias("class"), "group_size", F.round("m.distance", 6).alias("distance"))
    return picked.groupBy("id").agg(F.min("class").alias("class"), F.sum("group_size").alias("group_size"), F.min("distance").alias("distance"))


def _in_parts(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """Rows whose class also names the part, by quantiles of the axis that spreads most."""
    spread = rows.agg(*[F.stddev_pop(F.element_at("x", k + 1)) for k in range(dims)]).first()
    axis = F.element_at("x", 1 + max(range(dims), key=lambda k: spread[k] or 0.0))
    edges = sorted(set(rows.select(axis.alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.25 / parts)))
    part = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda n, e: n + F.when(axis >= e, 1).otherwise(0)) if edges else F.lit(0)
    return rows.withColumn("class", F.concat(part.cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), "class"), F.lit(""))))


def _without_part(name: Column) -> Column:
    own = F.substr(name, F.instr(name, F.lit(":")) + 1)
    return F.when(own != "", F.substr(own, F.lit(2)))


def _nearest(rows: DataFrame, groups: DataFrame, block: int, dims: int, id_type) -> DataFrame:
    """``(block, g, n, distance, id, class)``: each task's record nearest each group of one block, and its number of records."""
    from pyspark.sql.pandas.types import to_arrow_type

    by_class: dict = {}
    for g, (c, centre) in enumerate(sorted(zip(*(col.to_pylist() for col in groups.toArrow().columns)), key=lambda v: (str(v[0]), v[0] is not None, v[1]))):
        by_class.setdefault(c, []).append((g, centre))
    sent = rows.sparkSession.sparkContext.broadcast({c: (np.array([g for g, _ in v]), np.array([p for _, p in v])) for c, v in by_class.items()})
    batch_type = to_arrow_type(id_type)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(0)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)
            classes = np.array(batch.column(2).to_pylist(), dtype=object)
            for key, own in _by_class(classes).items():
                if key not in sent.value:
                    continue
                groups, at = sent.value[key]
                for lo in range(0, len(own), 4096):
                    part = own[lo : lo + 4096]
                    k = _square(x[part], at).argmin(1)
                    d = np.sqrt(((x[part] - at[k]) ** 2).sum(1))
                    order = np.lexsort((d, k))
                    first = np.flatnonzero(np.r_[True, np.diff(k[order]) > 0])
                    for f, count in zip(first, np.diff(np.r_[first, len(order)])):
                        g, dist = int(groups[k[order[f]]]), float(d[order[f]])
                        ties = part[(k == k[order[f]]) & (d == dist)]
                        one = min(ids[int(i)].as_py() for i in ties)
                        old = best.get(g)
                        n = int(count) + (old[0] if old else 0)
                        best[g] = (n, dist, one, key) if old is None or (dist, one) < (old[1], old[2]) else (n, *old[1:])
        yield pa.RecordBatch.from_arrays([
            pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.int64()), pa.array([b[1] for b in best.values()], pa.float64()),
            pa.array([b[2] for b in best.values()], batch_type), pa.array([b[3] for b in best.values()], pa.string()),
        ], names=["g", "n", "distance", "id", "class"])

    near = rows.select("id", "x", "class").mapInArrow(nearest, f"g int, n bigint, distance double, id {id_type.simpleString()}, class string")
    return near.withColumn("block", F.lit(block))
