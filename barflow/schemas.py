"""Fixed column names and types of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

OHLCV = ["open", "high", "low", "close", "volume"]
FEATURES = ["log_return", "atr", "volatility_ratio", "norm_rsi"]
TRADE_FEATURES = ["trade_count_30d", "rolling_win_rate", "rolling_avg_pnl", "rolling_volatility"]

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in OHLCV]
)

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}


def _struct(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column orders of the log tables and fields of the portfolio document.
TRADES = _struct(
    "entry_time timestamp, exit_time timestamp, symbol string, side string, entry_price double, exit_price double, "
    "size double, pnl_usd double, return_pct double, exit_reason string, position_id string"
)
SNAPSHOTS = _struct(
    "timestamp timestamp, cash_usd double, equity_usd double, starting_cash_usd double, "
    "open_positions bigint, position_symbol string, position_side string, position_size double, "
    "position_entry_price double, position_tp_price double, position_sl_price double, "
    "position_bars_held bigint, total_trades bigint, winning_trades bigint, win_rate double"
)
EVOLUTION = _struct(
    "timestamp timestamp, trigger string, n_features bigint, n_samples bigint, n_estimators bigint, "
    "learning_rate double, oos_accuracy double, in_sample_accuracy double, trade_count bigint, "
    "duration_seconds double, model_path string, notes string"
)
TRADE_COLUMNS, SNAPSHOT_COLUMNS, EVOLUTION_COLUMNS = TRADES.names, SNAPSHOTS.names, EVOLUTION.names
TELEMETRY_COLUMNS = [
    "timestamp", "type", "symbol", "price", "p_tp", "p_sl",
    "edge", "tp_price", "sl_price", "signal", "pnl",
]

POSITION = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("tp_price", T.DoubleType()),
        T.StructField("sl_price", T.DoubleType()),
        T.StructField("entry_time", T.StringType()),
        T.StructField("position_id", T.StringType()),
        T.StructField("bars_held", T.IntegerType()),
        T.StructField("remaining_size", T.DoubleType()),
    ]
)
PORTFOLIO = T.StructType(
    [
        T.StructField("starting_cash_usd", T.DoubleType()),
        T.StructField("cash_usd", T.DoubleType()),
        T.StructField("positions", T.ArrayType(POSITION)),
        T.StructField("total_trades", T.LongType()),
        T.StructField("winning_trades", T.LongType()),
        T.StructField("daily_pnl", T.DoubleType()),
        T.StructField("daily_start_equity", T.DoubleType()),
        T.StructField("last_timestamp", T.StringType()),
    ]
)
