from collections import Counter

import numpy as np
import pytest

from gridloom.llm import varied as vr
from pyspark.sql import functions as F


def test_ward_like_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 2))
    groups = {i: [i] for i in range(12)}
    want = []
    while len(groups) > 1:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        h, a, b = min((cost(groups[a], groups[b]), a, b) for a in groups for b in groups if a < b)
        want.append(h)
        groups[a] = groups[a] + groups.pop(b)
    got = sorted(h for h, _, _ in vr.ward(x))
    assert np.allclose(got, sorted(want))
    assert vr.ward(x[:1]) == []


def test_tree_keeps_all_counts():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (3000, 3)), np.zeros((500, 3))]
    tree = vr.FeatureTree(3, 100)
    tree.insert(x, np.ones(len(x)), (x**2).sum(1), x)
    assert len(tree.n) <= 100 and tree.n.sum() == len(x)
    assert np.allclose(tree.ls.sum(0), x.sum(0)) and np.isclose(tree.ss.sum(), (x**2).sum())
    assert np.bincount(tree.node).max() <= vr.BRANCHING


def test_every_kind_and_class(spark):
    rng = np.random.default_rng(4)
    big = [(i, [float(v) for v in rng.normal(0, 1, 2)], "a", 0) for i in range(2000)]
    rare = [(5000 + i, [1000.0 * (i + 1), 500.0], "a", 0) for i in range(5)] + [(6000, [0.0, 0.0], "b", 0), (6001, [3.0, 3.0], None, 0)]
    odd = [(7000, None, "a", 0), (7001, [1.0], "a", 0), (7002, [float("nan"), 1.0], "a", 0), (None, [0.0, 0.0], "a", 0)]
    df = spark.createDataFrame(big + rare + rare + odd, "k long, x array<double>, class string, id int")
    got = vr.varied_subset(df, "k", F.col("x"), F.col("class"), 2, 12).collect()
    ids = {r.id for r in got}
    assert {5000, 5001, 5002, 5003, 5004, 6000, 6001} <= ids and len(got) == len(ids) == 12
    assert sum(r.group_size for r in got) == len(big) + 2 * len(rare)
    few = vr.varied_subset(df, "k", F.col("x"), F.col("class"), 2, 1).collect()
    assert {r["class"] for r in few} == {"a", "b", None}
    assert vr.varied_subset(df.limit(0), "k", F.col("x"), F.col("class"), 2, 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0], "a") for i in range(50)], "k long, x array<double>, class string")
    assert [tuple(r)[:3] for r in vr.varied_subset(same, "k", F.col("x"), F.col("class"), 2, 5).collect()] == [(0, "a", 50)]


@pytest.mark.parametrize("bound", [100_000, 150])
def test_any_number_of_classes(spark, monkeypatch, bound):
    """Six hundred classes, groups in one block or several; the highest merges of all classes are left out."""
    monkeypatch.setattr(vr, "BLOCK_GROUPS", bound)
    rows = [(4 * c + k, [float(k // 2) * (c + 1), 0.001 * (k % 2)], f"class {c}" if c else None) for c in range(600) for k in range(4)]
    df = spark.createDataFrame(rows, "k long, x array<double>, class string")
    got = vr.varied_subset(df, "k", F.col("x"), F.col("class"), 2, min(bound, 700)).collect()
    twice = {c for c in Counter(r["class"] for r in got).items() if c[1] == 2}
    assert {r["class"] for r in got} == {None, *(f"class {c}" for c in range(1, 600))}
    assert sum(r.group_size for r in got) == len(rows)
    assert twice == ({(f"class {c}", 2) for c in range(500, 600)} if bound > 700 else set())


def test_rows_in_any_order(spark):
    """The subset is the same however the rows are ordered and spread."""
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1, (1500, 2)), rng.normal(6, 2, (900, 2)), np.repeat([[40.0, 1.0]], 600, axis=0), rng.uniform(-90, 90, (60, 2))].round(3)
    rows = [(i, [float(v) for v in p], "ab"[i % 2]) for i, p in enumerate(x)]
    got = []
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "k long, x array<double>, class string").repartition(5, F.rand(seed))
        got.append(sorted(map(tuple, vr.varied_subset(df, "k", F.col("x"), F.col("class"), 2, 80).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 80


def test_merge_ignores_the_order_of_summaries():
    rng = np.random.default_rng(1)
    tables = []
    for k in range(6):
        tree = vr.FeatureTree(3, 40)
        x = rng.normal(k % 2, 1, (500, 3))
        tree.insert(x, np.ones(500), (x**2).sum(1), x)
        tables.append(vr._entries("a", k, tree))
    both = [vr._merged(vr.pa.concat_tables(t), 3, 60) for t in (tables, tables[::-1])]
    assert (both[0].ls == both[1].ls).all() and (both[0].n == both[1].n).all()


def test_entries_stay_within_the_threshold():
    """No entry's members lie farther from its centre than a few thresholds in the root mean square."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 10, (5000, 4))
    tree = vr.FeatureTree(4, 200)
    tree.insert(x, np.ones(len(x)), (x**2).sum(1), x)
    radius = np.sqrt(np.maximum(tree.ss / tree.n - (tree.centre**2).sum(1), 0))
    assert radius.max() <= 1.5 * tree.threshold


def test_more_groups_than_one_linkage_gives(spark, monkeypatch):
    monkeypatch.setattr(vr, "FINAL_ENTRIES", 20)
    monkeypatch.setattr(vr, "TASK_ENTRIES", 15)
    rows = [(i, [float(i), 0.0], None if i % 3 else "a:=b") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x array<double>, class string")
    got = vr.varied_subset(df, "k", F.col("x"), F.col("class"), 2, 90).collect()
    assert 60 < len(got) <= 90 and {r["class"] for r in got} == {None, "a:=b"} and sum(r.group_size for r in got) == 300
