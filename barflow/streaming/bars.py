"""Bars and imbalances from tick streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from barflow.functions.microstructure import book_imbalance, flow_imbalance
from barflow.sources.bars import ticks_to_bars


def closed_bars(ticks: DataFrame, timeframe: str, lateness: str | None = None, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Tumbling bars in append mode: a bar appears once its interval is past the watermark.

    State per open (symbol, interval) is one partial aggregate, whatever the number of ticks.
    """
    return ticks_to_bars(ticks.withWatermark("ts", lateness or timeframe), timeframe, order)


def closed_flow(trades: DataFrame, interval: str, lateness: str | None = None) -> DataFrame:
    return flow_imbalance(trades.withWatermark("ts", lateness or interval), interval)


def book_stream(snapshots: DataFrame, bids: Column, asks: Column, levels: int | None = None) -> DataFrame:
    """Stateless: one imbalance per snapshot."""
    return snapshots.withColumn("imbalance", book_imbalance(bids, asks, levels))
