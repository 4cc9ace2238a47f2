import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import quantiles as qt
from pyspark.sql import functions as F


def rank_error(values, got, q):
    v = np.sort(values)
    want = min(max(int(np.ceil(q * len(v))), 1), len(v))
    low, high = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    return max(low - want, want - high, 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 9), st.integers(4, 64), st.integers(0, 99))
def test_bound_holds_for_any_split(n, parts, k, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(3, 2, n), int(seed % 3))
    whole = qt.Sketch(k)
    for part in np.array_split(values, parts):
        one = qt.Sketch(k)
        for piece in np.array_split(part, 3):
            one.add(piece)
        whole.merge(*(np.asarray(x) if isinstance(x, list) else x for x in one.pack()))
    n_, error, levels, sizes, items = whole.pack()
    assert n_ == n and (2.0 ** np.maximum(levels, 0) * sizes).sum() == n
    if n:
        fractions = [0.0, 0.01, 0.5, 0.9, 1.0]
        for q, got in zip(fractions, qt.read(np.array(levels), np.array(sizes), items, fractions)):
            assert rank_error(values, got, q) <= error


def test_empty_summary():
    assert np.isnan(qt.read(np.zeros(0, int), np.zeros(0, int), np.zeros(0), [0.5])[0])


@pytest.mark.parametrize("tasks", [1, 200])
def test_groups(spark, tasks):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3) if i % 10 else None, [float(v) for v in rng.normal(i % 3, 1, 2)], i) for i in range(6000)]
    odd = [(0, None, 1), (0, [], 1), (0, [1.0], 1), (0, [float("nan"), 9999.0], 1), (0, [None, float("inf")], 1), (0, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows + odd, "y int, x array<double>, band int").repartition(8)
    parts = qt.summarize(df, {"y": F.col("y")}, "x", 2, k=64)
    done = qt.percentiles(qt.combine(parts, ["y"], 64, tasks), ["y"], [0.5, 0.999]).collect()
    assert {(r.y, r.band) for r in done} == {(y, b) for y in (None, 0, 1, 2) for b in (1, 2)}
    for r in done:
        values = np.array([x[r.band - 1] for y, x, _ in rows + odd if y == r.y and x and len(x) >= r.band and x[r.band - 1] is not None])
        values = values[np.isfinite(values) & (values != 9999)]
        assert r.n == len(values) and rank_error(values, r.q50, 0.5) <= r.max_rank_error < 0.1 * r.n
    total = qt.percentiles(qt.combine(parts, [], 64), [], [0.5]).collect()
    assert sorted(r.band for r in total) == [1, 2]
    assert qt.percentiles(qt.summarize(df.limit(0), {"y": F.col("y")}, "x", 2), ["y"], [0.5]).count() == 0


def test_days_combine_to_the_whole(spark, small):
    from gridloom.llm.queries import p3_percentiles

    got = p3_percentiles(spark, small).filter("band = 1 and y = 1").collect()
    whole = [r for r in got if r.day is None]
    assert len(whole) == 1 and whole[0].n == sum(r.n for r in got if r.day is not None)


def test_many_days_merge_as_a_tree(spark, monkeypatch):
    """Summaries of many days meet in groups of bounded size, and the bound holds over all of them."""
    monkeypatch.setattr(qt, "FAN_IN", 4)
    rng = np.random.default_rng(6)
    values = rng.normal(0, 100, 6000).round(2)
    df = spark.createDataFrame([(int(i % 60), [float(v)]) for i, v in enumerate(values)], "day int, x array<double>")
    days = qt.summarize(df, {"day": F.col("day")}, "x", 1, 32)
    assert days.count() == 60
    whole = qt.combine(days, [], 32)
    assert "_up" in whole._jdf.queryExecution().toString()
    row = qt.percentiles(whole, [], [0.1, 0.5, 0.9]).first()
    ordered = np.sort(values)
    assert row.n == 6000 and 0 < row.max_rank_error < 1500
    for q, v in ((0.1, row.q10), (0.5, row.q50), (0.9, row.q90)):
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        assert low - row.max_rank_error <= np.ceil(q * 6000) <= high + row.max_rank_error
    again = qt.percentiles(qt.combine(days.repartition(7), [], 32), [], [0.1, 0.5, 0.9]).first()
    assert again == row
