"""Risk gates as ``struct<ok, reason>`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow.config import RESEARCH

OK = "ok"


def _gate(passes: Column, reason: Column) -> Column:
    return F.struct(passes.alias("ok"), reason.alias("reason"))


def _percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100.0)


def drawdown_gate(equity: Column, start: Column, limit: float = RESEARCH.drawdown_limit) -> Column:
    """Blocks at a drawdown of exactly the limit; without start equity it passes."""
    drawdown = F.try_divide(start - equity, start)
    blocked = (start > 0) & (drawdown >= limit)
    text = F.concat(F.lit("daily_drawdown "), _percent(drawdown), F.lit(" >= limit "), _percent(F.lit(limit)))
    return _gate(~blocked, F.when(start <= 0, F.lit("start_equity_zero")).when(blocked, text).otherwise(F.lit(OK)))


def exposure_gate(existing: Column, new: Column, equity: Column, limit: float = RESEARCH.max_exposure) -> Column:
    """Passes at exactly the limit; without equity it blocks."""
    share = F.try_divide(existing + new, equity)
    blocked = (equity <= 0) | (share > limit)
    text = F.concat(F.lit("exposure "), _percent(share), F.lit(" > limit "), _percent(F.lit(limit)))
    return _gate(~blocked, F.when(equity <= 0, F.lit("equity_zero")).when(blocked, text).otherwise(F.lit(OK)))


def notional_gate(price: Column, size: Column, minimum: float = RESEARCH.min_notional) -> Column:
    notional = F.abs(price * size)
    blocked = notional < minimum
    text = F.format_string(f"notional %.2f < minimum {minimum:.2f}", notional)
    return _gate(~blocked, F.when(blocked, text).otherwise(F.lit(OK)))


def risk_gate(
    equity: Column,
    start: Column,
    existing: Column,
    price: Column,
    size: Column,
    drawdown_limit: float = RESEARCH.drawdown_limit,
    minimum: float = RESEARCH.min_notional,
    exposure_limit: float = RESEARCH.max_exposure,
) -> Column:
    """All gates: ``struct<ok, reasons>`` with the rejections in a fixed order, or ``['ok']``."""
    gates = [
        drawdown_gate(equity, start, drawdown_limit),
        notional_gate(price, size, minimum),
        exposure_gate(existing, F.abs(price * size), equity, exposure_limit),
    ]
    rejected = F.array_compact(F.array(*[F.when(~g["ok"], g["reason"]) for g in gates]))
    passes = F.size(rejected) == 0
    return F.struct(
        passes.alias("ok"), F.when(passes, F.array(F.lit(OK))).otherwise(rejected).alias("reasons")
    )
