"""Fractional differencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, RESEARCH, Layout
from barflow.operators.series import LocalOp, apply_local, index_bars


def frac_weights(d: float, count: int) -> list[float]:
    """First ``count`` binomial weights of (1 - L)^d, newest lag first."""
    weights: list[float] = []
    for lag in range(max(count, 0)):
        weights.append(1.0 if lag == 0 else weights[-1] * (lag - 1 - d) / lag)
    return weights


def cut_weights(d: float, threshold: float, limit: int) -> list[float]:
    """Weights up to the first lag whose magnitude falls below ``threshold``, ``limit`` at most."""
    weights = [1.0][: max(limit, 0)]
    for lag in range(1, limit):
        w = weights[-1] * (lag - 1 - d) / lag
        if abs(w) < threshold:
            break
        weights.append(w)
    return weights


def cut_weights_of(d: Column, threshold: float, limit: int) -> Column:
    """``cut_weights`` of a column of degrees."""

    def step(acc: Column, lag: Column) -> Column:
        w = acc["w"] * (lag - 1 - d) / lag
        more = F.struct(w.alias("w"), F.concat(acc["out"], F.array(w)).alias("out"))
        return F.when(F.abs(w) >= threshold, more).otherwise(F.struct(F.lit(None).cast("double").alias("w"), acc["out"].alias("out")))

    one = F.struct(F.lit(1.0).alias("w"), F.array(F.lit(1.0)).cast("array<double>").alias("out"))
    lags = F.sequence(F.lit(1), F.lit(limit - 1)) if limit > 1 else F.array().cast("array<int>")
    return F.aggregate(lags, one, step, lambda acc: acc["out"])


def frac_diff_op(weights: list[float], value: str = "close", name: str = "frac_diff", short: bool = False) -> LocalOp:
    """Sliding dot product; NULL where the window is not full.

    With ``short`` a series with fewer rows than weights gets one value: its last row over all its rows.
    """
    width = len(weights)
    oldest_first = weights[::-1]

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_frame", F.collect_list(value).over(w.rowsBetween(1 - width, 0)))
        have = F.size("_frame")
        factors = F.slice(F.array(*[F.lit(x) for x in oldest_first]), F.lit(width + 1) - have, have)
        dot = F.aggregate(F.zip_with("_frame", factors, lambda x, f: x * f), F.lit(0.0), lambda a, x: a + x)
        last = F.lead("bar_idx").over(w).isNull() if short else F.lit(False)
        return df.withColumn("_last", last).withColumn(name, F.when((have == width) | F.col("_last"), dot)).drop("_frame", "_last")

    return LocalOp(width - 1, int(short), apply)


def frac_diff(
    series: DataFrame,
    value: str = "close",
    d: float = RESEARCH.frac_diff_d,
    threshold: float = RESEARCH.frac_diff_threshold,
    max_lag: int | None = None,
    timeframe_us: int | None = None,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Fractionally differenced ``value`` per symbol; rows without a full window are left out.

    Weights end at the first lag below ``threshold``, at ``max_lag`` or, without it, at the length of the series: a shorter
    series gives one row. Rows with a NULL value are dropped first; pass ``timeframe_us`` to have the rest numbered again.
    """
    limit = max_lag
    if limit is None:
        counts = series.where(F.col(value).isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
        limit = counts.agg(F.max("n")).first()[0] or 1
    weights = cut_weights(d, threshold, limit)
    if timeframe_us is not None:
        series = index_bars(
            series.where(F.col(value).isNotNull()).drop("bar_idx"), timeframe_us=timeframe_us, layout=layout
        )
    out = apply_local(series, frac_diff_op(weights, value, short=max_lag is None), layout=layout)
    return out.where(F.col("frac_diff").isNotNull())
