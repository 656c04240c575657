"""Performance statistics as aggregate or scalar column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER_GAMMA = 0.5772  # fixed value: four digits are part of the expected result


def accuracy(predicted: Column, actual: Column) -> Column:
    return F.avg((predicted == actual).cast("double"))


def sharpe(x: Column, periods: int | None = 252) -> Column:
    """Mean over sample deviation, annualized unless ``periods`` is None; 0 without variation."""
    ratio = F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)))
    scaled = ratio if periods is None else ratio * math.sqrt(periods)
    return F.coalesce(scaled, F.lit(0.0))


def unbiased_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.coalesce(F.skewness(x) * factor, F.lit(0.0))


def unbiased_kurtosis(x: Column) -> Column:
    """Excess kurtosis with the small-sample correction."""
    n = F.count(x).cast("double")
    value = F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3))
    return F.coalesce(value, F.lit(0.0))


def deflated_sharpe_z(
    sr: Column, trials: Column, sr_std: Column, skew: Column, kurt: Column, kurtosis_is_excess: bool = False
) -> Column:
    """z-score of the Sharpe ratio against the expected best of ``trials`` random strategies."""
    spread = F.when(sr_std <= 0, F.lit(1e-6)).otherwise(sr_std)
    root = F.sqrt(2.0 * F.ln(F.greatest(trials.cast("double"), F.lit(2.0))))
    best = root - (EULER_GAMMA + math.log(2 * math.pi)) / (2.0 * root)
    beyond = kurt if kurtosis_is_excess else kurt - 3.0
    variance = F.greatest(1.0 - skew * sr + beyond * sr * sr / 4.0, F.lit(1e-6))
    return (sr - best * spread) / (spread * F.sqrt(variance))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function; neither engine has ``erf``. One row per strategy."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2.0))).astype("float64")
