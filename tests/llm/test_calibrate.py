import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import calibrate as cal
from pyspark.sql import functions as F


def test_tilt_reaches_the_shares():
    counts, target = np.array([1000.0, 10, 0, 500]), np.array([0.2, 0.5, 0.1, 0.2])
    w = cal.tilt(counts, target)
    got = counts * w / (counts * w).sum()
    assert np.allclose(got[[0, 1, 3]], target[[0, 1, 3]] / target[[0, 1, 3]].sum()) and w[2] == 0
    assert (cal.tilt(np.zeros(3), target[:3]) == 0).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1), st.integers(0, 30)), min_size=1, max_size=12), st.integers(0, 800))
def test_allocation(rows, size):
    n, share, floor = (np.array(c, dtype=float) for c in zip(*rows))
    got = cal.allocate(n, share, floor, size)
    low = np.minimum(n, floor)
    assert (got <= n + 1e-6).all() and (got >= -1e-9).all()
    if low.sum() <= size:
        assert (got >= low - 1e-6).all()
    whole = cal.whole(got)
    assert (whole <= n).all() and (np.abs(whole - got) < 1 + 1e-6).all()


def test_pivotal_probabilities():
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.2])
    hits = np.zeros(5)
    for seed in range(4000):
        chosen, at, a = cal.pivot(p, np.random.default_rng(seed))
        assert at < 0 or 0 < a < 1
        hits[chosen] += 1
        assert len(chosen) == 2 and len(set(chosen.tolist())) == 2
    assert np.abs(hits / 4000 - p).max() < 0.04


def records(spark, counts):
    return spark.createDataFrame([(c, f"{c}{i}") for c, n in counts.items() for i in range(n)] + [(None, "x"), ("a", None)], "category string, id string")


def test_plan_and_draw(spark):
    r = records(spark, {"a": 300, "b": 40, "c": 3})
    r = r.union(r)  # every record delivered twice
    t = spark.createDataFrame(
        [("s", "a", 0.5, 0, 100), ("s", "b", 0.3, 10, 100), ("s", "c", 0.1, 2, 100), ("s", "none", 0.1, 1, 100), ("s", "none", 0.1, 1, 100), ("z", None, 0.5, None, 10), ("z", "b", None, 5, 10)],
        "target_set string, category string, share double, min_count long, sample_size long",
    )
    plan = {(x.target_set, x.category): x for x in cal.plan(t, r).collect()}
    assert {k: v.lack for k, v in plan.items()} == {("s", "a"): 0, ("s", "b"): 0, ("s", "c"): 7, ("s", "none"): 10, ("z", None): 5, ("z", "b"): 0}
    assert {k: v.gap for k, v in plan.items()} == {("s", "a"): 0, ("s", "b"): 0, ("s", "c"): 7, ("s", "none"): 10, ("z", None): 5, ("z", "b"): 0}
    assert plan["s", "a"].excess + plan["s", "b"].excess == 17 and plan["z", "b"].excess == plan["z", "b"].take
    assert sum(v.take for k, v in plan.items() if k[0] == "s") == 100 and plan["s", "c"].take == 3 and plan["z", "b"].take >= 5
    drawn = cal.draw(t, r).groupBy("target_set", "category").agg(F.count("id").alias("n"), F.count_distinct("id").alias("m")).collect()
    assert {(x.target_set, x.category): x.n for x in drawn} == {k: v.take for k, v in plan.items() if v.take}
    assert all(x.n == x.m for x in drawn)
    assert cal.draw(t, r.limit(0)).count() == 0 and cal.plan(t.limit(0), r).count() == 0


def test_targets_missed_without_lack(spark):
    """Minimum counts that leave no room for a share: every share that the sample misses is told."""
    t = spark.createDataFrame([("s", "a", 0.8, 0, 100), ("s", "b", 0.1, 40, 100), ("s", "c", 0.1, 40, 100)], "target_set string, category string, share double, min_count long, sample_size long")
    got = {x.category: (x.take, x.lack, x.gap, x.excess) for x in cal.plan(t, records(spark, {"a": 1000, "b": 1000, "c": 1000})).collect()}
    assert got == {"a": (20, 0, 60, 0), "b": (40, 0, 0, 30), "c": (40, 0, 0, 30)}


@pytest.mark.parametrize("spare", [(6.0, 20.0), (-1.0, -3.0)])
def test_thinning(spark, monkeypatch, spare):
    """A hot category is thinned, and drawn from all its records should chance leave too few."""
    monkeypatch.setattr(cal, "SPARE", spare)
    t = spark.createDataFrame([(f"s{k}", c, x, 0, 200) for k in range(2) for c, x in (("a", 0.9), ("b", 0.1))], "target_set string, category string, share double, min_count long, sample_size long")
    drawn = cal.draw(t, records(spark, {"a": 20_000, "b": 30})).collect()
    ids = {k: {x.id for x in drawn if x.target_set == k} for k in ("s0", "s1")}
    assert {k: len(v) for k, v in ids.items()} == {"s0": 200, "s1": 200} and len(drawn) == 400
    assert len({i for i in ids["s0"] & ids["s1"] if i.startswith("a")}) < 20
    numbers = [int(i[1:]) for i in ids["s0"] if i.startswith("a")]
    assert 7000 < np.mean(numbers) < 13_000


def test_draw_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cal, "PIVOT_RECORDS", 50)
    t = spark.createDataFrame([("s", "a", 0.9, 0, 77), ("s", "b", 0.1, 0, 77)], "target_set string, category string, share double, min_count long, sample_size long")
    drawn = {x.category: x["count"] for x in cal.draw(t, records(spark, {"a": 600, "b": 90})).groupBy("category").count().collect()}
    assert drawn == {"a": 69, "b": 8}


def test_classes(spark):
    labels = spark.createDataFrame([("open shrub", "2"), ("burn scar", "6"), ("woodland", "1"), (None, "9")], "classname string, id string")
    rows = [(1, " 02", "junk"), (2, "2.0", None), (3, None, "Open_Shrub "), (4, None, "woodalnd"), (5, None, "burn\u00a0scarr"), (6, None, "?"), (7, "77", "woodland"), (8, None, None), (None, "1", None), (9, "1", None), (9, None, "wodland")]
    pts = spark.createDataFrame([(*r, "x") for r in rows], "pid long, lab string, cls string, key string")
    got = {(x.id, x.category) for x in cal.resolve_classes(pts, labels, "pid", "lab", "cls").collect()}
    assert got == {(1, "open shrub"), (2, "open shrub"), (3, "open shrub"), (4, "woodland"), (5, "burn scar"), (9, "woodland")}


def test_found_on_the_tables(spark, small, duck):
    from gridloom.llm.queries import p2_found

    want = duck.execute("""with t as (select distinct * from sample_targets where drawn_from = 'extractor_samples'), n as (select cast(y as varchar) as category, count(distinct sample_id) as n from extractor_samples group by 1)
        select distinct target_set, t.category from t left join n using (category) where coalesce(n, 0) < share * sample_size or coalesce(n, 0) < min_count""").fetchall()
    sets = {s for s, _ in want}
    got = {tuple(r) for r in p2_found(spark, small).collect()}
    assert {g for g in got if g[0] in sets} == set(want)


@pytest.mark.parametrize("word", ["abc", "a", ""])
def test_slips(spark, word):
    got = spark.createDataFrame([(word,)], "w string").filter("w <> ''").select(cal.slips(F.col("w"))).collect()
    assert [set(x[0]) for x in got] == ([{word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}] if word else [])
