"""Radiometric calibration of adjacent rasters, by aggregation per band.

Pairs are ``(band, x, y)``: reference and target value of one cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import wrap_cast

#: Mean normalized difference beyond which a band is corrected.
THRESHOLD = 0.005


#: Fixed value: the largest finite double.
_LARGEST = 1.7976931348623157e308


def _finite(value: Column) -> Column:
    """NaN as 0, infinities as the largest finite numbers; null stays null."""
    return F.least(F.greatest(F.nanvl(value, F.lit(0.0)), F.when(value.isNotNull(), F.lit(-_LARGEST))), F.when(value.isNotNull(), F.lit(_LARGEST)))


def minmax_difference(pairs: DataFrame) -> DataFrame:
    """Adds nx, ny (min-max normalized per band) and diff; null where a band is constant.

    The ranges are one aggregated row per band. NaN counts as 0, an infinity as
    the largest finite number of its sign.
    """
    clean = pairs.withColumns({c: _finite(F.col(c).cast("double")) for c in ("x", "y")})
    ranges = clean.groupBy("band").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    unit = lambda v: F.try_divide(F.col(v) - F.col(f"{v}0"), F.col(f"{v}1") - F.col(f"{v}0"))
    out = clean.join(ranges, "band").withColumns({"nx": unit("x"), "ny": unit("y")})
    return out.withColumn("diff", F.abs(F.col("nx") - F.col("ny"))).drop("x0", "x1", "y0", "y1")


def band_models(pairs: DataFrame) -> DataFrame:
    """``(band, slope, intercept, r2, mean_diff)`` by least squares of y on x.

    Everything is sums: one aggregation after the ranges. A constant band has
    null slope and intercept.
    """
    return minmax_difference(pairs).groupBy("band").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.bround(F.avg("diff"), 5).alias("mean_diff"),
    )


def bands_correlation(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The models of the bands whose mean difference exceeds the threshold."""
    return band_models(pairs).filter(F.col("mean_diff") > threshold)


def polynomial_fit(pairs: DataFrame, degree: int) -> DataFrame:
    """``(band, power, coefficient)`` of a least-squares polynomial of y on x.

    Power sums of the centred, scaled x are aggregated per band; the normal
    equations of each band are then solved where its one row is.
    """
    stats = pairs.groupBy("band").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-12)).alias("s"))
    z = (F.col("x") - F.col("m")) / F.col("s")
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(z, F.lit(float(k)))
    sums = pairs.join(stats, "band").filter("x is not null and y is not null").groupBy("band", "m", "s").agg(
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("a"), F.array(*[F.sum(power(k) * F.col("y")) for k in range(degree + 1)]).alias("b")
    )

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for band, m, s, a, b in pdf[["band", "m", "s", "a", "b"]].itertuples(index=False):
                normal = np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                scaled = np.polynomial.Polynomial(np.linalg.lstsq(normal, np.array(b), rcond=None)[0])
                plain = scaled(np.polynomial.Polynomial([-m / s, 1 / s])).coef
                rows += [(band, k, float(plain[k]) if k < len(plain) else 0.0) for k in range(degree + 1)]
            yield pd.DataFrame(rows, columns=["band", "power", "coefficient"])

    kind = pairs.schema["band"].dataType.simpleString()
    return sums.mapInPandas(solve, f"band {kind}, power int, coefficient double")


def r_squared(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """``(band, r2)`` of any line ``slope * x + intercept`` against the pairs."""
    means = pairs.groupBy("band").agg(F.avg("y").alias("mean"))
    joined = pairs.join(models.select("band", "slope", "intercept"), "band").join(means, "band")
    miss = F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept"))
    spread = F.col("y") - F.col("mean")
    return joined.groupBy("band").agg((1 - F.try_divide(F.sum(miss * miss), F.sum(spread * spread))).alias("r2"))


def line(slope, x, intercept):
    """The plotted line of a model: the intercept is subtracted on purpose (see README)."""
    return slope * x - intercept


def corrected(value, intercept):
    """A corrected pixel: the intercept is subtracted, a result below zero keeps the value; cast to 16 unsigned bits, as the pixels are."""
    moved = value - intercept
    return wrap_cast(F.when(moved < 0, value).otherwise(moved), "uint16")


def apply_corrections(pixels_long: DataFrame, models: DataFrame) -> DataFrame:
    """Long pixels with every modelled band corrected; other bands pass through.

    There is one model row per band; how the two meet is left to the planner,
    which sees the size.
    """
    joined = pixels_long.join(models.select("band", "intercept"), "band", "left")
    value = F.when(F.col("intercept").isNull(), F.col("value").cast("bigint")).otherwise(corrected(F.col("value"), F.col("intercept")))
    return joined.withColumn("value", value).drop("intercept")
