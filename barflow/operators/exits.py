"""First barrier touch after entry, for positions without a holding limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators.series import join_per_key

FANOUT = 256


def _packed(series: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """Groups of ``fanout`` consecutive items as one array row, plus their price range."""
    item = F.struct("idx", "low", "high")
    return series.groupBy(*keys, F.floor(F.col("idx") / fanout).cast("bigint").alias("grp")).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def _first(items: Column, after: Column) -> Column:
    hits = F.filter(
        items,
        lambda b: (b.idx > after) & ((b.low <= F.col("sl_price")) | (b.high >= F.col("tp_price"))),
    )
    return F.get(hits, F.lit(0))["idx"]


def _search(asked: DataFrame, series: DataFrame, keys: list[str], levels: int, fanout: int) -> DataFrame:
    """``(keys, ask, hit)``: first idx after ``from`` whose range reaches a barrier, NULL if none.

    Looks into the own group, then for the first later group that reaches a barrier (the same
    question one level up), then into that group. Each step joins one position to one group.
    """
    packed = _packed(series, keys, fanout)
    own = (
        asked.withColumn("grp", F.floor(F.col("from") / fanout).cast("bigint"))
        .join(packed.select(*keys, "grp", "items"), [*keys, "grp"], "left")
        .withColumn("hit", _first(F.col("items"), F.col("from")))
        .drop("items")
    )
    if levels <= 1:
        return own.drop("grp", "from")
    open_rows = own.where(F.col("hit").isNull()).select(
        *keys, "ask", "tp_price", "sl_price", F.col("grp").alias("from")
    )
    groups = packed.select(*keys, F.col("grp").alias("idx"), "low", "high")
    later = _search(open_rows, groups, keys, levels - 1, fanout).withColumnRenamed("hit", "grp")
    inside = later.join(packed.select(*keys, "grp", "items"), [*keys, "grp"], "left").withColumn(
        "hit", _first(F.col("items"), F.lit(-1).cast("bigint"))
    )
    columns = [*keys, "ask", "tp_price", "sl_price", "hit"]
    return own.where(F.col("hit").isNotNull()).select(*columns).unionByName(inside.select(*columns))


def exit_join(
    positions: DataFrame,
    indexed: DataFrame,
    keys: Sequence[str] = ("symbol",),
    fanout: int = FANOUT,
    levels: int | None = None,
) -> DataFrame:
    """Positions + ``exit_idx, exit_time, exit_price, exit_reason, bars_held``.

    ``positions(position_id, symbol, entry_idx, tp_price, sl_price, ...)``; the exit is the first
    later bar with low <= stop (at the stop) or high >= target (at the target), the stop winning
    a tie. Open positions keep NULL exit columns and count the bars seen so far.
    """
    keys = list(keys)
    series = indexed.select(*keys, F.col("bar_idx").alias("idx"), "low", "high")
    if levels is None:
        longest = indexed.agg(F.max("bar_idx")).first()[0] or 0
        levels = 1
        while fanout**levels <= longest:
            levels += 1
    asked = positions.select(
        *keys, F.col("position_id").alias("ask"), F.col("entry_idx").alias("from"), "tp_price", "sl_price"
    )
    found = _search(asked, series, keys, levels, fanout).select(
        *keys, F.col("ask").alias("position_id"), F.col("hit").alias("exit_idx")
    )
    bars = indexed.select(*keys, F.col("bar_idx").alias("exit_idx"), F.col("ts").alias("exit_time"), F.col("low").alias("_low"))
    last = indexed.groupBy(*keys).agg(F.max("bar_idx").alias("_last"))
    met = positions.join(found, [*keys, "position_id"], "left").join(bars, [*keys, "exit_idx"], "left")
    out = join_per_key(met, last, keys, "entry_idx")
    stopped = F.col("_low") <= F.col("sl_price")
    closed = F.col("exit_idx").isNotNull()
    return out.withColumns(
        {
            "exit_price": F.when(closed, F.when(stopped, F.col("sl_price")).otherwise(F.col("tp_price"))),
            "exit_reason": F.when(closed, F.when(stopped, F.lit("STOP_LOSS")).otherwise(F.lit("TAKE_PROFIT"))),
            "bars_held": F.when(closed, F.col("exit_idx") - F.col("entry_idx") - 1).otherwise(
                F.col("_last") - F.col("entry_idx")
            ),
        }
    ).drop("_low", "_last")
