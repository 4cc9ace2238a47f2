"""A join whose hot keys are split gives what a plain join gives."""

import pytest

from gridloom.operators.skew import split_join
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_like_a_plain_join(spark, most):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}" if i % 5 else None) for i in range(900)], "i long, k string")
    single = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "k string, v int")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = split_join(rows, single, "k", sizes, "i", most=most)
    assert sorted(map(tuple, got.select("i", "k", "v").collect())) == sorted(map(tuple, rows.join(single, "k").select("i", "k", "v").collect()))
    parts = got.groupBy("k").agg(F.count_distinct("_salt").alias("p"), F.max("_salt").alias("m")).collect()
    assert {x.k: x.p for x in parts} == ({"hot": 12, "k0": 1, "k3": 1} if most == 50 else {"hot": 1, "k0": 1, "k3": 1})
    assert split_join(rows.limit(0), single, "k", sizes.limit(0), "i").count() == 0
