"""Kernel densities per key over binned values: groups of any size become at most ``bins`` rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kernel_matrix(low: float, high: float, bins: int, width: float, kernel: str) -> np.ndarray:
    """Kernel values between bin centres: ``gaussian`` of standard deviation ``width``, or ``von_mises``
    of concentration ``width`` on angles."""
    x = low + (np.arange(bins) + 0.5) * (high - low) / bins
    d = x[:, None] - x[None]
    if kernel == "von_mises":
        return np.exp(width * (np.cos(d) - 1)) / (2 * math.pi * np.i0(width) * math.exp(-width))
    return np.exp(-((d / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi))


def binned_density(df: DataFrame, key: str, value: str, low: float, high: float, bins: int, width: float, kernel: str = "gaussian", at_least: int = 50) -> DataFrame:
    """``(key, bin, x, density)`` on the bin centres, for keys of more than ``at_least`` values in the range.

    Values are counted per key and bin first, map-side, so a popular key is no large group. Null, NaN
    and values outside ``[low, high)`` are left out.
    """
    inside = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= low) & (F.col(value) < high))
    bin_ = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    counts = inside.groupBy(key, F.least(bin_, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(key))).where(F.col("total") > at_least)
    kernels = kernel_matrix(low, high, bins, width, kernel)

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins)
        n[group["bin"].to_numpy()] = group["n"].to_numpy()
        x = low + (np.arange(bins) + 0.5) * (high - low) / bins
        return pd.DataFrame({key: [group[key].iloc[0]] * bins, "bin": np.arange(bins, dtype=np.int32), "x": x, "density": kernels @ n / n.sum()})

    return counts.groupBy(key).applyInPandas(smooth, f"`{key}` {dict(df.dtypes)[key]}, bin int, x double, density double")


def modes(density: DataFrame, key: str) -> DataFrame:
    """The likeliest place of each key and its density, the lowest place on ties."""
    best = density.groupBy(key).agg(F.min(F.struct((-F.round("density", 9)).alias("d"), "x")).alias("m"))
    return best.select(key, F.col("m.x").alias("mode"), (-F.col("m.d")).alias("max_density"))
