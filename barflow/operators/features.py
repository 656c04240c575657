"""Stationary features from bars: true range, Wilder averages, log return, RSI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, LIVE, Layout
from barflow.operators.series import LocalOp, State, apply_local


def ewm_state(name: str, value: Callable[[WindowSpec], Column], alpha: float, first_idx: int = 0) -> State:
    """The recursive mean y_t = (1-a) y_{t-1} + a x_t of ``value(w)`` from bar ``first_idx`` on; NULL counts as 0.

    The first bar of a frame inside the series has no term: what came before it and its own term are carried in.
    """
    carried = (F.col("_pos") == 0) & (F.col("_from") > 0)
    weight = F.when(F.col("bar_idx") == first_idx, F.lit(1.0)).when(carried, F.lit(0.0)).otherwise(F.lit(alpha))
    return State(name, 1.0 - alpha, lambda w: F.coalesce(value(w), F.lit(0.0)) * weight)


def ewm(df: DataFrame, state: State, w: WindowSpec, first_idx: int = 0, min_periods: int = 1) -> DataFrame:
    """Add the mean as one running sum of rescaled terms: y_t = d^t * (carry + sum(term_i d^-i)) inside a frame.

    The carry is the mean at the frame's first bar; the op needs one bar of look-back. Without decay a mean is its last term.
    """
    carry = F.coalesce(F.col(f"_carry_{state.name}"), F.lit(0.0))
    if state.decay:
        scaled = state.term(w) * F.pow(F.lit(state.decay), -F.col("_pos"))
        df = df.withColumn("_term", scaled)
        total = F.sum("_term").over(w.rowsBetween(Window.unboundedPreceding, 0)) + carry
        mean = total * F.pow(F.lit(state.decay), F.col("_pos"))
    else:
        df = df.withColumn("_term", state.term(w))
        mean = F.when((F.col("_pos") == 0) & (F.col("_from") > 0), carry).otherwise(F.col("_term"))
    return df.withColumn(state.name, F.when(F.col("bar_idx") - first_idx + 1 >= max(min_periods, 1), mean)).drop("_term")


def _true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def true_range() -> LocalOp:
    return LocalOp(1, 0, lambda df, w: df.withColumn("true_range", _true_range(w)))


def wilder_atr(period: int = LIVE.period, warm_up: bool = True, name: str = "atr") -> LocalOp:
    """Average true range. ``warm_up`` hides the first ``period - 1`` values (live variant);
    without it the first value is high - low (research variant)."""
    mean = ewm_state(name, _true_range, 1.0 / period)
    return LocalOp(1, 0, lambda df, w: ewm(df, mean, w, 0, period if warm_up else 1), (mean,))


def log_return(name: str = "log_return") -> LocalOp:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn(name, F.ln(F.try_divide("close", F.lag("close").over(w))))

    return LocalOp(1, 0, apply)


def wilder_rsi(period: int = LIVE.period, name: str = "norm_rsi") -> LocalOp:
    """RSI on 0..1. All-gain windows give 1, windows without any move give NULL."""
    move = lambda w: F.col("close") - F.lag("close").over(w)
    gains = ewm_state("_gain", lambda w: F.greatest(move(w), F.lit(0.0)), 1.0 / period, 1)
    losses = ewm_state("_loss", lambda w: F.greatest(-move(w), F.lit(0.0)), 1.0 / period, 1)

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ewm(ewm(df, gains, w, 1, period), losses, w, 1, period)
        ratio = F.try_divide("_gain", "_loss")
        rsi = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), F.lit(1.0)).otherwise(1.0 - 1.0 / (1.0 + ratio))
        return df.withColumn(name, rsi).drop("_gain", "_loss")

    return LocalOp(1, 0, apply, (gains, losses))


def volatility_ratio() -> LocalOp:
    return LocalOp(0, 0, lambda df, w: df.withColumn("volatility_ratio", F.try_divide("atr", "close")))


def feature_op(period: int = LIVE.period) -> LocalOp:
    """The four model features in one op that looks one bar back."""
    parts = [wilder_atr(period), log_return(), volatility_ratio(), wilder_rsi(period)]

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        for part in parts:
            df = part.apply(df, w)
        return df

    return LocalOp(max(p.back for p in parts), 0, apply, tuple(s for p in parts for s in p.states))


def build_features(indexed: DataFrame, period: int = LIVE.period, layout: Layout = LAYOUT) -> DataFrame:
    """Indexed bars + ``log_return, atr, volatility_ratio, norm_rsi``; one shuffle."""
    return apply_local(indexed, feature_op(period), layout=layout)


def volume_average(k: int, name: str = "vma") -> LocalOp:
    """Mean volume of the current and the ``k`` earlier bars."""
    return LocalOp(
        k, 0, lambda df, w: df.withColumn(name, F.avg("volume").over(w.rowsBetween(-k, 0)))
    )
