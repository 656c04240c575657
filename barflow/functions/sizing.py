"""Fractional Kelly sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import RESEARCH, ResearchConfig


def fractional_kelly(
    win_prob: Column, win_loss: Column, cfg: ResearchConfig = RESEARCH, kelly_fraction: float | None = None, strict: bool = False
) -> Column:
    """Share of equity to risk, between 0 and the configured cap.

    Probabilities outside (0, 1) or ratios <= 0 give NULL, or an error with ``strict``.
    """
    share = cfg.kelly_fraction if kelly_fraction is None else kelly_fraction
    valid = (win_prob > 0) & (win_prob < 1) & (win_loss > 0)
    full = win_prob - F.try_divide(1.0 - win_prob, win_loss)
    value = F.least(F.greatest(share * full, F.lit(0.0)), F.lit(cfg.kelly_cap))
    if strict:
        problem = F.when(win_loss <= 0, F.lit("win_loss_ratio must be > 0")).otherwise(
            F.lit("win_prob must be between 0 and 1 (exclusive)")
        )
        return F.when(valid, value).otherwise(F.raise_error(problem).cast("double"))
    return F.when(valid, value)


def kelly_units(
    share: Column,
    equity: Column,
    price: Column,
    cfg: ResearchConfig = RESEARCH,
    min_notional: float | None = None,
    max_share: float | None = None,
) -> Column:
    floor = cfg.min_notional if min_notional is None else min_notional
    cap = cfg.kelly_cap if max_share is None else max_share
    target = F.least(share * equity, cap * equity, equity)
    usable = (equity > 0) & (price > 0) & (target >= floor)
    return F.when(share.isNull(), F.lit(None)).when(usable, F.try_divide(target, price)).otherwise(F.lit(0.0))


def size_positions(
    signals: DataFrame,
    cfg: ResearchConfig = RESEARCH,
    kelly_fraction: float | None = None,
    min_notional: float | None = None,
    max_share: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """Adds ``kelly_f, size_units, notional, meets_min`` to ``(equity, price, win_prob, win_loss)``."""
    floor = cfg.min_notional if min_notional is None else min_notional
    share = fractional_kelly(F.col("win_prob"), F.col("win_loss"), cfg, kelly_fraction, strict)
    out = signals.withColumn("kelly_f", share)
    units = kelly_units(F.col("kelly_f"), F.col("equity"), F.col("price"), cfg, min_notional, max_share)
    out = out.withColumn("size_units", units)
    out = out.withColumn("notional", F.col("size_units") * F.col("price"))
    return out.withColumn("meets_min", F.col("notional") >= floor)
