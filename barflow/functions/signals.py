"""Expected-edge signals and meta gating as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import LIVE, LiveConfig


def signal_columns(
    price: Column, atr: Column, p_tp: Column, p_sl: Column, trained_rows: Column, cfg: LiveConfig = LIVE
) -> dict[str, Column]:
    """Decision per scored row. The take-profit distance has a floor so that small ATRs cannot
    produce targets that costs eat up; models trained on too few rows sit out."""
    cold = trained_rows < cfg.min_warmup_rows
    gain = F.greatest(cfg.tp_atr * atr, F.lit(cfg.min_tp_distance))
    risk = cfg.sl_atr * atr
    costs = 2.0 * (price * cfg.fee_rate + price * cfg.slippage_bps / 10_000.0)
    edge = p_tp * gain - p_sl * risk - costs
    buy = (edge > 0) & (p_tp > cfg.p_tp_threshold)
    return {
        "signal": F.when(~cold & F.coalesce(buy, F.lit(False)), F.lit("BUY")).otherwise(F.lit("SIT_OUT")),
        "reason": F.when(cold, F.lit("WARMUP")),
        "price": price,
        "p_tp": F.when(cold, F.lit(0.0)).otherwise(p_tp),
        "p_sl": F.when(cold, F.lit(0.0)).otherwise(p_sl),
        "p_time": F.when(cold, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - p_tp - p_sl)),
        "edge": F.when(cold, F.lit(0.0)).otherwise(edge),
        "tp_price": price + gain,
        "sl_price": price - risk,
    }


def score_signals(scored: DataFrame, cfg: LiveConfig = LIVE, price: str = "close") -> DataFrame:
    """``scored`` has ``symbol, ts, close, atr, p_tp, p_sl, trained_rows``."""
    columns = signal_columns(
        F.col(price), F.col("atr"), F.col("p_tp"), F.col("p_sl"), F.col("trained_rows"), cfg
    )
    return scored.select("symbol", "ts", *[c.alias(n) for n, c in columns.items()])


def entry_size(cash: Column, price: Column, fraction: float = LIVE.position_fraction) -> Column:
    return F.when(price > 0, F.try_divide(fraction * cash, price)).otherwise(F.lit(0.0))


def meta_label(predicted: Column, actual: Column) -> Column:
    """1 where an active label was predicted right, else 0."""
    return F.when((actual != 0) & (predicted == actual), 1).otherwise(0)


def pick_direction(probabilities: Sequence[tuple[int, Column]], threshold: float = 0.5) -> Column:
    """Class whose probability reaches the threshold; the later one in order wins, none gives 0."""
    out = F.lit(0)
    for label, p in probabilities:
        out = F.when(p >= threshold, F.lit(label)).otherwise(out)
    return out


def side_probabilities(direction: Column, correct: Column) -> tuple[Column, Column]:
    """(P(-1), P(+1)) from the primary direction and the chance that it is right."""
    up = F.when(direction == 1, correct).otherwise(1.0 - correct)
    return 1.0 - up, up


def gated_bet(p_down: Column, p_up: Column, threshold: float = 0.5) -> Column:
    return F.when(p_up >= threshold, 1).when(p_down >= threshold, -1).otherwise(0)
