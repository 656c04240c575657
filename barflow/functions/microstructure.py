"""Order-book and trade-flow imbalance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _balance(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a - b, F.nullif(a + b, F.lit(0.0))), F.lit(0.0))


def wide_levels(columns: Sequence[str]) -> Column:
    """Fold ``level_0 .. level_k`` columns into one array, best level first."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def book_imbalance(bids: Column, asks: Column, levels: int | None = None) -> Column:
    """(bid - ask) / (bid + ask) volume over the top ``levels``; 0 for an empty book."""

    def depth(side: Column) -> Column:
        top = side if levels is None else F.slice(side, 1, levels)
        return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))

    return _balance(depth(bids), depth(asks))


def flow_imbalance(trades: DataFrame, interval: str) -> DataFrame:
    """Signed volume share per symbol and interval from ``(symbol, ts, side, size)``."""
    def volume(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("size")).otherwise(F.lit(0.0)))

    return (
        trades.groupBy("symbol", F.window("ts", interval).alias("_w"))
        .agg(volume("buy").alias("buy"), volume("sell").alias("sell"))
        .select("symbol", F.col("_w.start").alias("ts"), "buy", "sell", _balance(F.col("buy"), F.col("sell")).alias("imbalance"))
    )
