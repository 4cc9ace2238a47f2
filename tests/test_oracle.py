"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import math

import numpy as np
import pandas as pd
import pytest

from gridloom.plans import analysis, proximity, rasters, workflows

MODULES = (rasters, analysis, proximity, workflows)
QUERIES = {k: q for m in MODULES for k, q in m.queries().items()}
SQL = {k: s for m in MODULES for k, s in m.oracle_sql().items()}


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else float(v) + 0.0
    return int(v) if isinstance(v, int | np.integer) else v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


#: Thirty forests take minutes; test_workflows has the operator with small ones.
LONG = {"rf_report"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
