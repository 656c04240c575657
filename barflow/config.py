"""Default parameters. Values are fixed by the behaviour the library reproduces."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LiveConfig:
    """Live scoring path: barriers, signal economics, retraining cadence."""

    tp_atr: float = 1.5
    sl_atr: float = 1.0
    vertical: int = 5
    period: int = 14
    fee_rate: float = 0.001
    slippage_bps: float = 2.0
    p_tp_threshold: float = 0.55
    min_tp_distance: float = 250.0
    min_warmup_rows: int = 1000
    train_window: int = 1000
    retrain_every: int = 100
    min_samples: int = 120
    position_fraction: float = 0.10
    starting_cash: float = 10_000.0
    trade_lookback_days: int = 30


@dataclass(frozen=True)
class ResearchConfig:
    """Research path: barriers, sizing, gates, backtest, drift, regimes."""

    pt_mult: float = 1.5
    sl_mult: float = 1.0
    max_hold: int = 5
    atr_period: int = 14
    kelly_fraction: float = 0.25
    kelly_cap: float = 0.05
    min_notional: float = 5.0
    step_size: float = 0.0001
    drawdown_limit: float = 0.03
    max_exposure: float = 0.5
    maker_fee: float = 0.0002
    taker_fee: float = 0.0005
    slippage_k: float = 0.0001
    initial_capital: float = 10_000.0
    block_len: int = 10
    psi_threshold: float = 0.25
    ref_window: int = 100
    test_window: int = 50
    psi_bins: int = 10
    regime_low: float = 0.2
    regime_high: float = 0.8
    regime_window: int = 20
    frac_diff_d: float = 0.5
    frac_diff_threshold: float = 1e-4


@dataclass(frozen=True)
class Layout:
    """Physical layout of a long series.

    ``chunk_bars`` rows of one symbol form a chunk, the unit of work of a window task.
    ``fanout`` chunks form a block when chunk summaries are scanned. ``chunk_rows`` rows form a
    chunk where rows are not numbered bars.
    """

    chunk_bars: int = 2048
    fanout: int = 1024
    levels: int = 2
    chunk_rows: int = 250_000


LIVE = LiveConfig()
RESEARCH = ResearchConfig()
LAYOUT = Layout()
