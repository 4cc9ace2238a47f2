"""Percentiles of huge numeric columns by collapsing weighted buffers (problem 3).

A summary is a list of sorted buffers of ``k`` values; a buffer of level ``h``
stands for ``k * 2**h`` values, each of its values for ``2**h``. Two buffers of
one level collapse into one of the next: of their merged sequence every second
value stays, starting at the first or at the second position in turn. One
collapse at level ``h`` moves any rank by at most ``2**h``; the sum over all
collapses that were made is carried along as the proven bound of the rank error. Deterministic: no random
choice anywhere. Values that fill no buffer stay exact.

Summaries combine in any order (files, days, partitions), as the bound of the
combination is the sum of the bounds plus that of the new collapses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a buffer: the rank error is at most log2(n / k) / (2 k) of n.
BUFFER = 1024
#: Partial summaries of one group that a task of the merge tree takes.
FAN_IN = 32
MASK = 9999.0

SUMMARY = "n bigint, error bigint, levels array<int>, sizes array<int>, items array<double>"


class Sketch:
    """The mergeable summary of one group."""

    __slots__ = ("error", "full", "k", "n", "rest", "turn")

    def __init__(self, k: int = BUFFER):
        self.k, self.n, self.error = k, 0, 0
        self.full: list[list[np.ndarray]] = []
        self.rest = np.zeros(0)
        self.turn: list[int] = []

    def add(self, values: np.ndarray) -> None:
        """Add finite values."""
        self.n += len(values)
        self._fill(np.concatenate([self.rest, values]))

    def _fill(self, values: np.ndarray) -> None:
        k = self.k
        whole = len(values) // k
        self.rest = values[whole * k :]
        for i in range(whole):
            self._put(0, np.sort(values[i * k : (i + 1) * k]))

    def _put(self, level: int, buffer: np.ndarray) -> None:
        while len(self.full) <= level:
            self.full.append([])
            self.turn.append(0)
        at = self.full[level]
        at.append(buffer)
        if len(at) == 2:
            both = np.sort(np.concatenate(at))
            at.clear()
            start, self.turn[level] = self.turn[level], 1 - self.turn[level]
            self.error += 1 << level
            self._put(level + 1, both[start::2])

    def merge(self, n: int, error: int, levels: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> None:
        """Add a packed summary."""
        self.n, self.error = self.n + int(n), self.error + int(error)
        at = 0
        for level, size in zip(levels.tolist(), sizes.tolist()):
            part = items[at : at + size]
            at += size
            if level < 0:
                self._fill(np.concatenate([self.rest, part]))
            else:
                self._put(level, part)

    def pack(self) -> tuple[int, int, list[int], list[int], np.ndarray]:
        """Level -1 holds the values that fill no buffer."""
        parts = [(h, b) for h, at in enumerate(self.full) for b in at]
        if len(self.rest):
            parts.append((-1, self.rest))
        return self.n, self.error, [h for h, _ in parts], [len(b) for _, b in parts], np.concatenate([b for _, b in parts]) if parts else np.zeros(0)


def read(levels: np.ndarray, sizes: np.ndarray, items: np.ndarray, fractions: list[float]) -> list[float]:
    """Quantiles of a packed summary: the value at rank ``ceil(q * n)``."""
    if not len(items):
        return [float("nan")] * len(fractions)
    weight = np.repeat(2 ** np.maximum(levels, 0).astype(np.int64), sizes)
    order = np.argsort(items, kind="stable")
    total = np.cumsum(weight[order])
    ranks = [min(max(int(np.ceil(q * total[-1])), 1), int(total[-1])) for q in fractions]
    return [float(items[order][np.searchsorted(total, r)]) for r in ranks]


def _rows(keys: list[tuple], sketches: list[Sketch], schema: pa.Schema) -> pa.RecordBatch:
    packed = [s.pack() for s in sketches]
    columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(schema) - 5)]
    items = [p[4] for p in packed]
    offsets = np.zeros(len(items) + 1, dtype=np.int32)
    np.cumsum([len(i) for i in items], out=offsets[1:])
    flat = pa.array(np.concatenate(items) if items else np.zeros(0))
    return pa.RecordBatch.from_arrays([
        *columns, pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], pa.int64()),
        pa.array([p[2] for p in packed], pa.list_(pa.int32())), pa.array([p[3] for p in packed], pa.list_(pa.int32())),
        pa.ListArray.from_arrays(pa.array(offsets), flat),
    ], schema=schema)


def summarize(df: DataFrame, keys: dict[str, Column], vector_col: str, dims: int, k: int = BUFFER) -> DataFrame:
    """``(keys..., band, n, error, levels, sizes, items)``: one summary per group and band.

    ``keys`` name the grouping expressions (null is a group of its own); band
    counts from 1. Null vectors, nulls, NaN, infinities and the mask are missing
    values and do not count; a short vector has the bands it has, bands beyond
    ``dims`` are ignored. Repeated rows count as often as they are there. Groups
    without a value have no row.

    Each task condenses what it reads to one summary per group and band before
    anything is shuffled, and summaries then merge as a tree of bounded fan-in,
    so a group with most of the rows is never gathered as rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(keys)
    source = df.select(*[c.alias(n) for n, c in keys.items()], F.col(vector_col).cast("array<double>").alias("x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{fields}{', ' if fields else ''}band int, {SUMMARY}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Sketch]] = {}
        for batch in batches:
            x = batch.column(len(names))
            matrix, groups, order, starts = _by_group(batch, names, x, dims)
            for g, key in enumerate(groups):
                rows = matrix[order[starts[g] : starts[g + 1]]]
                own = held.get(key)
                if own is None:
                    own = held[key] = [Sketch(k) for _ in range(dims)]
                for band in range(dims):
                    v = rows[:, band]
                    v = v[np.isfinite(v) & (v != MASK)]
                    if len(v):
                        own[band].add(v)
        flat = [((*key, b + 1), s) for key, own in held.items() for b, s in enumerate(own) if s.n]
        for at in range(0, len(flat), 2000):
            part = flat[at : at + 2000]
            yield _rows([p[0] for p in part], [p[1] for p in part], arrow)

    return combine(source.mapInArrow(condense, schema), names, k, source.rdd.getNumPartitions())


def _by_group(batch: pa.RecordBatch, names: list[str], x: pa.Array, dims: int):
    """The vectors as a matrix (NaN where missing), and the rows of each group."""
    lengths = np.nan_to_num(np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=float)
    if (lengths == dims).all():
        matrix = flat.reshape(-1, dims)
    else:
        matrix = np.full((len(lengths), dims), np.nan)
        row = np.repeat(np.arange(len(lengths)), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ok = col < dims
        matrix[row[ok], col[ok]] = flat[ok]
    if not names:
        return matrix, [()], np.arange(len(matrix)), [0, len(matrix)]
    code = np.zeros(len(matrix), dtype=np.int64)
    for i in range(len(names)):
        one = batch.column(i).dictionary_encode(null_encoding="encode")
        code = code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(order) else np.zeros(0, dtype=int)
    heads = pa.array(order[starts])
    groups = list(zip(*[batch.column(i).take(heads).to_pylist() for i in range(len(names))])) if len(order) else []
    return matrix, groups, order, [*starts.tolist(), len(order)]


def combine(parts: DataFrame, keys: list[str], k: int = BUFFER, tasks: int | None = None) -> DataFrame:
    """Merge summaries (of tasks, files or days) to one per ``keys`` and band.

    Columns of ``parts`` besides ``keys``, band and the summary are dropped.
    The merge is a tree: no group takes many more than ``FAN_IN`` summaries of a
    key and band, however many there are. ``tasks`` is the number of tasks that
    made ``parts``, each at most one summary a key and band; without it the
    summaries are counted, and dealt to the groups by a hash of their content.
    Within a merge they are ordered by content, so equal input gives equal
    output. Works on any union of summaries made with the same ``k``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    by = [*keys, "band"]
    parts = parts.select(*by, "n", "error", "levels", "sizes", "items")
    arrow, names = to_arrow_schema(parts.schema), parts.columns

    def merge(table: pa.Table) -> pa.Table:
        rows = []
        for n, error, levels, sizes, items in zip(*(table.column(c) for c in ("n", "error", "levels", "sizes", "items"))):
            values = np.asarray(items.values.to_numpy(zero_copy_only=False), dtype=float)
            rows.append((-n.as_py(), error.as_py(), float(values.sum()), levels.values.to_numpy(), sizes.values.to_numpy(), values))
        rows.sort(key=lambda r: r[:3])
        out = Sketch(k)
        for n, error, _, levels, sizes, values in rows:
            out.merge(-n, error, levels, sizes, values)
        return pa.Table.from_batches([_rows([tuple(table.column(c)[0].as_py() for c in by)], [out], arrow)])

    if tasks is None:
        most = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        made = parts.withColumn("_task", F.pmod(F.xxhash64(*names), F.lit(max(most, 1))).cast("int"))
    else:
        most, made = tasks, parts.withColumn("_task", F.spark_partition_id())
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        made = made.withColumn("_up", F.floor(F.col("_task") / FAN_IN).cast("int")).groupBy(*by, "_up").applyInArrow(_keep_task(merge, names), f"{_ddl(parts)}, _task int")
    return made.select(*names).groupBy(*by).applyInArrow(merge, parts.schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _keep_task(merge, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        out = merge(table.select(names))
        return out.append_column("_task", table.column("_up").slice(0, 1).cast(pa.int32()))

    return run


def percentiles(summaries: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """``(keys..., band, n, max_rank_error, q<percent>...)`` of summaries.

    Each value has a rank within ``max_rank_error`` of ``ceil(q * n)``; 0 means
    exact.
    """
    labels = [f"q{100 * q:g}".replace(".", "_") for q in fractions]
    kept = [f for f in summaries.schema.fields if f.name in (*keys, "band")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n bigint, max_rank_error bigint, " + ", ".join(f"{c} double" for c in labels)
    order = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [read(np.asarray(a), np.asarray(b), np.asarray(c, dtype=float), fractions) for a, b, c in zip(pdf["levels"], pdf["sizes"], pdf["items"])]
            out = pdf[[*order, "n"]].copy()
            out["max_rank_error"] = pdf["error"]
            for i, label in enumerate(labels):
                out[label] = [v[i] for v in values]
            yield out

    return summaries.mapInPandas(run, schema)
