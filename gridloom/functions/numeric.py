"""Scalar expressions of band arithmetic, all built-in functions; only rings of very many edges leave generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of the unsigned and signed integer types that values are wrapped into.
_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "int8": 8, "int16": 16, "int32": 32}


def wrap_cast(value: Column, dtype: str) -> Column:
    """Cast as a C compiler would: truncate toward zero, then wrap around.

    Null stays null; NaN and infinities, which have no integer, become 0.
    """
    if dtype in ("float32", "float64", "int64"):
        return value.cast({"float32": "float", "float64": "double", "int64": "bigint"}[dtype])
    if dtype not in _BITS:
        raise ValueError(f"unknown dtype {dtype}")
    span = 1 << _BITS[dtype]
    wide = value.cast("double")
    whole = F.when(F.isnan(wide) | (F.abs(wide) == float("inf")), F.lit(0).cast("bigint")).otherwise(wide.cast("bigint"))
    low = F.pmod(whole, F.lit(span))
    return low if dtype.startswith("u") else F.when(low >= span // 2, low - span).otherwise(low)


def finite_or_zero(value: Column) -> Column:
    """NaN and infinities become 0, null stays null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Single-precision quotient; 0 where the denominator is 0, null for null bands."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double")).cast("float")
    return F.when(numerator.isNull() | denominator.isNull(), F.lit(None).cast("float")).otherwise(F.coalesce(quotient, F.lit(0).cast("float")))


def scaled(value: Column, scale: int = 1000) -> Column:
    """Scale 1: single precision as is; 1000: times 1000, truncated to an integer."""
    if scale == 1:
        return value
    if scale != 1000:
        raise ValueError("scale must be 1 or 1000")
    return (value * F.lit(1000).cast("float")).cast("bigint")


def ndvi(red: Column, nir: Column) -> Column:
    return ratio(nir - red, nir + red)


def nbr(nir: Column, swir: Column) -> Column:
    return ratio(nir - swir, nir + swir)


def ndwi(green: Column, nir: Column) -> Column:
    return ratio(green - nir, green + nir)


def bsi(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    return ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


#: Index name -> builder of its expression; extend it to add an index.
INDEXES: dict[str, Callable[..., Column]] = {"ndvi": ndvi, "nbr": nbr, "ndwi": ndwi, "bsi": bsi}


def index_column(name: str, bands: list[Column], scale: int = 1000) -> Column:
    """The expression of a registered index; an unknown name is a ``ValueError``."""
    if name not in INDEXES:
        raise ValueError(f"unknown index {name}; known are {sorted(INDEXES)}")
    return scaled(INDEXES[name](*bands), scale)


#: Edges that are tested one by one in generated code; more become one array literal, so that the plan does not grow with them.
PLAIN_EDGES = 64


def in_piece(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Is the point inside an outline and outside its holes? By the parity of edges crossed to its right."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    if not edges:
        return F.lit(False)
    one = lambda x1, y1, x2, y2: F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    if len(edges) <= PLAIN_EDGES:
        crossed = reduce(lambda n, c: n + c, [one(*[F.lit(float(v)) for v in (*a, *b)]) for a, b in edges])
    else:
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in (*a, *b)]) for a, b in edges])
        crossed = F.aggregate(rows, F.lit(0), lambda n, e: n + one(e[0], e[1], e[2], e[3]))
    return F.pmod(crossed, F.lit(2)) == 1


def in_region(x: Column, y: Column, pieces: list[list[list[tuple[float, float]]]]) -> Column:
    """Is the point inside any piece of a region?"""
    return reduce(lambda a, b: a | b, [in_piece(x, y, rings) for rings in pieces], F.lit(False))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Is the point inside the ring?"""
    return in_piece(x, y, [ring])
