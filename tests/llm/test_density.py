import numpy as np
import pytest

from gridloom.llm import density as dn


def brute(ids, x, eps, least=3):
    label = np.arange(len(x))
    d = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    a, b = np.nonzero(np.triu(d, 1))
    label = dn.find(label, a, b)
    out = set()
    for root in np.unique(label):
        members = sorted(set(ids[label == root].tolist()))
        if len(members) >= least:
            out |= {(members[0], m) for m in members}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "sample_id long, x array<double>")


@pytest.mark.parametrize(("seed", "dims", "spread"), [(1, 3, 12.0), (2, 4, 30.0), (3, 2, 60.0), (4, 5, 45.0)])
def test_like_brute_force(spark, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(dn, "BOX_ROWS", 20)
    monkeypatch.setattr(dn, "SIDE", 4.0)
    monkeypatch.setattr(dn, "CROWD", 8)
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 3000, (12, dims))
    x = np.r_[np.repeat(centres, 12, 0) + rng.normal(0, spread, (144, dims)), rng.uniform(0, 3000, (60, dims)), np.linspace(0, 2500, 26)[:, None] + np.zeros((1, dims)), centres[:1].repeat(30, 0)]
    ids = rng.permutation(len(x)) + 100
    got = {tuple(r) for r in dn.clusters(frame(spark, ids, x), "sample_id", "x", 150.0, dims).collect()}
    assert got == brute(ids, x, 150.0)


def test_full_boxes_are_taken_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dn, "BOX_LIMIT", 30)
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 160, (120, 3)), rng.uniform(-900, 900, (60, 3))]
    ids = rng.permutation(len(x))
    got = {tuple(r) for r in dn.clusters(frame(spark, ids, x), "sample_id", "x", 150.0, 3).collect()}
    assert got == brute(ids, x, 150.0)


def test_full_boxes_are_cut_by_further_axes(spark, monkeypatch):
    monkeypatch.setattr(dn, "BOX_LIMIT", 40)
    monkeypatch.setattr(dn, "SIDE", 4.0)
    blocks = []
    monkeypatch.setattr(dn, "_in_blocks", lambda marked, keys: blocks.append(keys) or (marked.drop("_n"), keys))
    rng = np.random.default_rng(7)
    x = np.r_[rng.uniform(0, 5000, (400, 4)), rng.normal(2500, 100, (30, 4))]
    ids = rng.permutation(len(x))
    got = {tuple(r) for r in dn.clusters(frame(spark, ids, x), "sample_id", "x", 150.0, 4).collect()}
    assert got == brute(ids, x, 150.0) and blocks == []


@pytest.mark.parametrize("gap", [149.0, 151.0])
@pytest.mark.parametrize("closest", [48, 1])
def test_two_dense_cells(spark, monkeypatch, gap, closest):
    """Many members on either side, of which one pair at most is near enough; decided in blocks."""
    monkeypatch.setattr(dn, "CLOSEST", closest)
    monkeypatch.setattr(dn, "PAIR_BLOCK", 16)
    side = 150 / np.sqrt(2)
    rng = np.random.default_rng(3)
    left, right = rng.uniform(0, 1, (200, 2)) * [30, side * 0.98] + [0.1, 0.1], rng.uniform(0, 1, (200, 2)) * [30, side * 0.98] + [2 * side + 50, 0.1]
    x = np.r_[left, right, [[side * 0.99, 50.0]], [[side * 0.99 + gap, 50.0]]]
    ids = np.r_[np.arange(400) + 10, [900, 901]]
    got = {tuple(r) for r in dn.clusters(frame(spark, ids, x), "sample_id", "x", 150.0, 2).collect()}
    assert got == brute(ids, x, 150.0)
    assert len({c for c, _ in got}) == (1 if gap < 150 else 2)


def test_doubtful_members_link(spark):
    """Representatives are too far apart, other members of the cells are not."""
    side = 150 / np.sqrt(2)
    x = np.array([[1.0, 1.0], [side - 1, side - 1], [side + 140.0, side - 1.0], [side + 239.0, side - 1.0], [2.0, 2.0]])
    ids = np.array([5, 9, 3, 4, 6])
    got = {tuple(r) for r in dn.clusters(frame(spark, ids, x), "sample_id", "x", 150.0, 2).collect()}
    assert got == brute(ids, x, 150.0)


def test_unusable_and_repeated(spark):
    good = [0.0, 0.0]
    rows = [(1, good, 1), (1, good, 1), (2, [10.0, 0.0], 2), (3, [0.0, 9.0], 3), (4, None, 1), (5, [0.0], 1), (6, [0.0, None], 1), (7, [0.0, float("nan")], 1), (8, [0.0, float("inf")], 1), (9, [9999.0, 0.0], 1), (None, good, 1), (10, [1.0, 2.0, 3.0], 1), (11, [900.0, 0.0], 1), (12, [910.0, 0.0], 1), (12, [910.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>, cluster_id long")
    got = dn.clusters(df, "sample_id", "x", 150.0, 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert dn.clusters(df.limit(0), "sample_id", "x", 150.0, 2).count() == 0
    told = [tuple(r)[:4] for r in dn.describe(df, got, "sample_id", "x", 2).orderBy("rank").collect()]
    assert told[0] == (1, 3, 1, 1) and len(told) == 3


def test_large_clusters_are_split(spark, monkeypatch):
    """Parts of a cluster give the same members and medoids as the whole."""
    from gridloom.operators import skew

    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 60, (300, 2)), rng.normal(3000, 20, (40, 2)), rng.uniform(-9000, -4000, (20, 2))]
    df = frame(spark, np.arange(len(x)), x)
    whole = dn.clusters(df, "sample_id", "x", 150.0, 2)
    told = sorted(map(tuple, dn.describe(df, whole, "sample_id", "x", 2).collect()))
    split = skew.split_join
    monkeypatch.setattr(dn, "split_join", lambda *a, **k: split(*a, **k, most=25))
    again = dn.clusters(df, "sample_id", "x", 150.0, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, dn.describe(df, again, "sample_id", "x", 2).collect())) == told and len(told) >= 6


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (30, 20), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in dn.components(links, "t").collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 20: 20, 21: 20, 30: 20}
