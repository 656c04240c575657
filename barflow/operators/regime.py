"""Volatility regimes: rolling ATR percentile, classes, trading mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, RESEARCH, Layout
from barflow.operators.features import wilder_atr
from barflow.operators.series import LocalOp, apply_local


def rolling_rank(value: str = "atr", window: int = RESEARCH.regime_window, name: str = "atr_pct") -> LocalOp:
    """Percentile rank of the newest of ``window`` values, ties averaged; NULL until the window is full."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_frame", F.collect_list(value).over(w.rowsBetween(1 - window, 0)))
        less = F.size(F.filter("_frame", lambda x: x < F.col(value)))
        same = F.size(F.filter("_frame", lambda x: x == F.col(value)))
        rank = (less + (same + 1) / 2.0) / F.lit(float(window))
        full = (F.size("_frame") == window) & F.col(value).isNotNull()
        return df.withColumn(name, F.when(full, rank)).drop("_frame")

    return LocalOp(window - 1, 0, apply)


def regime_class(pct: Column, low: float = RESEARCH.regime_low, high: float = RESEARCH.regime_high) -> Column:
    return F.when(pct < low, F.lit("LOW")).when(pct > high, F.lit("HIGH")).when(pct.isNotNull(), F.lit("MEDIUM"))


def regime_mask(regime: Column, allowed: Sequence[str] = ("MEDIUM",)) -> Column:
    """True where the class is allowed; unknown classes and an empty list give False."""
    if not allowed:
        return F.lit(False)
    return F.coalesce(regime.isin(*allowed), F.lit(False))


def regime_op(
    window: int = RESEARCH.regime_window,
    low: float = RESEARCH.regime_low,
    high: float = RESEARCH.regime_high,
    allowed: Sequence[str] = ("MEDIUM",),
) -> LocalOp:
    atr = wilder_atr(RESEARCH.atr_period, warm_up=False, name="_atr")
    rank = rolling_rank("_atr", window, "_pct")

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = rank.apply(atr.apply(df, w), w)
        df = df.withColumn("volatility_regime", regime_class(F.col("_pct"), low, high))
        return df.withColumn("tradable", regime_mask(F.col("volatility_regime"), allowed)).drop("_atr", "_pct")

    return LocalOp(atr.back + rank.back, 0, apply, atr.states)


def attach_regime(indexed: DataFrame, layout: Layout = LAYOUT, **options) -> DataFrame:
    """Indexed bars + ``volatility_regime`` and ``tradable``; all other columns unchanged."""
    return apply_local(indexed, regime_op(**options), layout=layout)
