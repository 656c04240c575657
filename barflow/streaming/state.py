"""Keyed state operators: incremental features, positions, drift."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barflow.config import LIVE, RESEARCH

EPS = 1e-6


# --------------------------------------------------------------------------- features
FEATURE_OUT = (
    "symbol string, ts timestamp, open double, high double, low double, close double, volume double, "
    "log_return double, atr double, volatility_ratio double, norm_rsi double"
)
FEATURE_STATE = "n bigint, close double, atr double, gain double, loss double"


def decayed(x: np.ndarray, alpha: float, carry: float | None) -> np.ndarray:
    """``s[i] = s[i-1] + alpha * (x[i] - s[i-1])`` from ``carry``, or from the first value itself.

    A running sum of rescaled terms, in blocks short enough for the powers of the decay to stay in double precision.
    """
    if len(x) == 0 or alpha >= 1.0:
        return x.copy()
    out = np.empty(len(x))
    s = x[0] if carry is None else carry
    block = max(1, int(-230.0 / math.log1p(-alpha)))
    powers = (1.0 - alpha) ** np.arange(1, min(block, len(x)) + 1)
    for start in range(0, len(x), block):
        part = x[start : start + block]
        scale = powers[: len(part)]
        out[start : start + block] = scale * (s + np.cumsum(alpha * part / scale))
        s = out[start + len(part) - 1]
    return out


def stream_features(bars: DataFrame, period: int = LIVE.period) -> DataFrame:
    """Features of each new bar from five numbers of state per symbol.

    Bars of one symbol must arrive in time order across batches, as closed bars do; inside a
    batch they are sorted here.
    """
    alpha = 1.0 / period

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(batches)).sort_values("ts")
        n, before, atr, gain, loss = state.get if state.exists else (0, np.nan, None, None, None)
        high, low, close = (bars[c].to_numpy("float64") for c in ("high", "low", "close"))
        seen = n + np.arange(len(bars))
        last = np.concatenate([[before], close[:-1]])
        moves = (close - last)[seen > 0]
        known = n > 1  # the second bar brings the first move

        def averaged(x: np.ndarray, carry: float | None) -> np.ndarray:
            return np.concatenate([np.zeros(len(bars) - len(x)), decayed(x, alpha, carry)])

        with np.errstate(all="ignore"):
            atrs = averaged(np.fmax(high - low, np.fmax(np.abs(high - last), np.abs(low - last))), atr if n else None)
            gains = averaged(np.maximum(moves, 0.0), gain if known else None)
            losses = averaged(np.maximum(-moves, 0.0), loss if known else None)
            rsi = np.where(losses == 0, 1.0, 1.0 - 1.0 / (1.0 + gains / losses))
            ready = seen + 1 >= period
            extra = pd.DataFrame(
                {
                    "log_return": np.log(close / last),
                    "atr": np.where(ready, atrs, np.nan),
                    "volatility_ratio": np.where(ready, atrs / close, np.nan),
                    "norm_rsi": np.where((seen >= period) & ((losses > 0) | (gains > 0)), rsi, np.nan),
                }
            )
        state.update((int(n + len(bars)), float(close[-1]), float(atrs[-1]), float(gains[-1]), float(losses[-1])))
        names = ["symbol", "ts", "open", "high", "low", "close", "volume"]
        yield pd.concat([bars[names].reset_index(drop=True), extra], axis=1)

    return bars.groupBy("symbol").applyInPandasWithState(
        update, FEATURE_OUT, FEATURE_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --------------------------------------------------------------------------- positions (T5)
POSITION_OUT = (
    "portfolio string, ts timestamp, event string, symbol string, side string, position_id string, entry_time timestamp, "
    "entry_price double, exit_price double, size double, pnl_usd double, return_pct double, exit_reason string, "
    "bars_held int, cash_usd double, equity_usd double, open_positions int"
)
POSITION_COLUMNS = [part.strip().split()[0] for part in POSITION_OUT.split(",")]
POSITION_STATE = "cash double, positions string"


def stream_positions(
    signals: DataFrame, starting_cash: float = LIVE.starting_cash, fraction: float = LIVE.position_fraction
) -> DataFrame:
    """Paper positions per portfolio from ``(portfolio, symbol, ts, high, low, close, signal,
    price, tp_price, sl_price)``, one row per bar.

    For each bar, in (ts, symbol) order: the open position of the symbol is tested (stop before
    target), then a BUY opens one if the symbol is flat and the cash suffices. Events ``open``
    and ``close`` are emitted with the cash after them, and one ``snapshot`` per bar. Admission
    depends on all earlier events of a portfolio, so a portfolio is one key.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(batches)).sort_values(["ts", "symbol"])
        cash, held = (state.get[0], json.loads(state.get[1])) if state.exists else (starting_cash, {})
        out = []

        def emit(event: str, bar, position: dict | None = None, **more) -> None:
            marks = sum(p["size"] * p["mark"] for p in held.values())
            row = dict.fromkeys(POSITION_COLUMNS)
            row.update(portfolio=key[0], ts=bar.ts, event=event, symbol=bar.symbol, cash_usd=cash, equity_usd=cash + marks, open_positions=len(held))
            if position:
                row.update(
                    side="BUY", position_id=position["id"], entry_time=pd.Timestamp(position["ts"], unit="us"),
                    entry_price=position["entry"], size=position["size"], bars_held=position["bars"],
                )
            out.append({**row, **more})

        for bar in bars.itertuples(index=False):
            position = held.get(bar.symbol)
            if position:
                position["mark"] = bar.close
                stopped, reached = bar.low <= position["sl"], bar.high >= position["tp"]
                if stopped or reached:
                    price = position["sl"] if stopped else position["tp"]
                    cash += price * position["size"]
                    del held[bar.symbol]
                    emit(
                        "close", bar, position, exit_price=price, exit_reason="STOP_LOSS" if stopped else "TAKE_PROFIT",
                        pnl_usd=(price - position["entry"]) * position["size"], return_pct=(price / position["entry"] - 1.0) * 100.0,
                    )
                else:
                    position["bars"] += 1
            if bar.signal == "BUY" and bar.symbol not in held:
                size = fraction * cash / bar.price if bar.price > 0 else 0.0
                if bar.price * size <= cash:
                    cash -= bar.price * size
                    stamp = bar.ts.value // 1000
                    held[bar.symbol] = {
                        "id": f"{bar.symbol}_{stamp}", "ts": stamp, "entry": bar.price, "size": size,
                        "tp": bar.tp_price, "sl": bar.sl_price, "bars": 0, "mark": bar.close,
                    }
                    emit("open", bar, held[bar.symbol])
            emit("snapshot", bar, held.get(bar.symbol))
        state.update((cash, json.dumps(held)))
        frame = pd.DataFrame(out, columns=POSITION_COLUMNS)
        frame["entry_time"] = pd.to_datetime(frame["entry_time"])
        frame["bars_held"] = frame["bars_held"].astype("Int32")
        numbers = ["entry_price", "exit_price", "size", "pnl_usd", "return_pct"]
        frame[numbers] = frame[numbers].astype("float64")
        yield frame

    return signals.groupBy("portfolio").applyInPandasWithState(
        update, POSITION_OUT, POSITION_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --------------------------------------------------------------------------- drift
def windows_psi(series: np.ndarray, ref_window: int, test_window: int, bins: int, block: int = 4096) -> np.ndarray:
    """PSI of each full pair of windows, on the quantile bins of the first; ``block`` windows at a time."""
    size = ref_window + test_window
    if len(series) < size:
        return np.empty(0)
    framed, out = np.lib.stride_tricks.sliding_window_view(series, size), []
    at = np.arange(1, bins) / bins * (ref_window - 1)
    low = at.astype(int)
    high = np.minimum(low + 1, ref_window - 1)
    for start in range(0, len(framed), block):
        frames = framed[start : start + block]
        # to the last bit as ``operators.drift`` has them: an edge may fall on a value
        ordered = np.sort(frames[:, :ref_window], axis=1)
        edges = (ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (at - low)).T
        # equal edges are one: the empty bin between them does not count
        inner = edges[1:] != edges[:-1]
        counted = np.concatenate([np.ones((1, len(frames)), bool), inner, np.ones((1, len(frames)), bool)])

        def shares(x: np.ndarray) -> np.ndarray:
            below = np.stack([np.zeros(len(x)), *((x < e[:, None]).sum(axis=1) for e in edges), np.full(len(x), x.shape[1])])
            filled = np.where(counted, np.diff(below, axis=0) + EPS, 0.0)
            return np.where(counted, filled / filled.sum(axis=0), 1.0)

        p, q = shares(frames[:, :ref_window]), shares(frames[:, ref_window:])
        out.append(((p - q) * np.log(p / q)).sum(axis=0))
    return np.concatenate(out)


def stream_drift(
    values: DataFrame,
    ref_window: int = RESEARCH.ref_window,
    test_window: int = RESEARCH.test_window,
    threshold: float = RESEARCH.psi_threshold,
    bins: int = RESEARCH.psi_bins,
) -> DataFrame:
    """``(symbol, ts, psi, drift)`` for each new value of ``(symbol, ts, value)``.

    The windows end with the newest value. State is the last ``ref_window + test_window`` values;
    before that many exist, psi is NULL and drift False. NULL values are skipped.
    """
    size = ref_window + test_window

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("ts")
        kept = list(state.get[0]) if state.exists else []
        series = np.asarray([*kept, *new["value"]], dtype="float64")
        scores = windows_psi(series[max(0, len(kept) + 1 - size) :], ref_window, test_window, bins)
        state.update((series[-size:].tolist(),))
        psi = pd.Series(np.concatenate([np.full(len(new) - len(scores), np.nan), scores]))
        yield pd.DataFrame(
            {"symbol": key[0], "ts": new["ts"].to_numpy(), "psi": psi, "drift": (psi > threshold).fillna(False).astype(bool)}
        )

    return values.groupBy("symbol").applyInPandasWithState(
        update, "symbol string, ts timestamp, psi double, drift boolean", "values array<double>", "append", GroupStateTimeout.NoTimeout
    )
