"""Scratch tables: where they lie and when they go."""

import os
import time
from types import SimpleNamespace

import pytest

from gridloom import session
from gridloom.operators.overlap import number_rows


def left(spark):
    folder = f"{session.shared_dir(spark)}/gridloom".removeprefix("file://")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def swept(spark, want):
    """Sweep until ``want`` tables are left; the JVM learns of what Python dropped after a while."""
    for _ in range(40):
        session.sweep(spark, collect=True)
        if len(left(spark)) <= want:
            break
        time.sleep(0.25)
    return left(spark)


def test_tables_go_when_no_plan_reads_them(spark):
    before = swept(spark, 0)
    numbered = number_rows(spark.range(20).selectExpr("id as k", "0 as id", "'x' as _part2"), "k", "n")
    derived = numbered.filter("n > 5").select("k", "n")
    del numbered
    assert len(swept(spark, len(before) + 1)) == len(before) + 1
    assert derived.count() == 15
    del derived
    assert swept(spark, len(before)) == before


def test_discard_and_clear(spark):
    one, two = session.cut(spark.range(3).toDF("a"), "one"), session.cut(spark.range(3).toDF("a"), "two")
    assert one.count() == two.count() == 3
    session.discard(one)
    assert not any(p.startswith("one-") for p in left(spark))
    session.clear(spark)
    assert left(spark) == []
    session.sweep(spark, collect=True)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, other=None: other)
    on = lambda master, own=None: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: own))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(on("spark://host:7077"))
    assert session.shared_dir(on("yarn", "hdfs://all/shared/")) == "hdfs://all/shared"
