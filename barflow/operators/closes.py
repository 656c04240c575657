"""Partial closes: sizes of closing fills matched to the lots they close, in order of opening."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.operators.portfolio import trade_columns
from barflow.operators.series import Measure, depth_chunks, running, running_whole
from barflow.session import cut_lineage

#: Sizes up to this count as nothing.
DUST = 1e-12


def _events(lots: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Lots (``seq`` 1) and fills (0) as rows of one kind, each text once."""
    return lots.select(
        *keys, F.col("entry_time").alias("ts"), F.lit(1).alias("seq"), F.col("position_id").alias("id"), F.col("size").cast("double").alias("opened"), F.lit(0.0).alias("asked"),
        F.col("entry_price").alias("price"), F.col("side").alias("note"),
    ).unionByName(
        fills.select(
            *keys, "ts", F.lit(0).alias("seq"), F.col("fill_id").alias("id"), F.lit(0.0).alias("opened"), F.col("size").cast("double").alias("asked"),
            "price", F.col("reason").alias("note"),
        ),
    ).where("opened > 0 OR asked > 0")


def _intervals(dealt: DataFrame, scan: Callable[..., DataFrame]) -> DataFrame:
    """``start`` and ``stop`` of the interval of each lot and effective fill on the scale of cumulative size.

    With A opened and F asked to close so far, a fill closes up to F - max(0, max over fills so far of F - A): what is asked
    while nothing is open is lost. Fills come before lots of the same time.
    """
    order = ["ts", "seq", "id"]
    summed = scan(dealt, order, [Measure("_a", "sum", F.col("opened")), Measure("_f", "sum", F.col("asked"))])
    over = F.when(F.col("seq") == 0, F.col("_f") - F.col("_a"))
    lost = scan(summed.withColumn("_over", over), order, [Measure("_lost", "max", F.col("_over"))], True)
    before = F.greatest(F.col("_lost"), F.lit(0.0))
    is_lot = F.col("seq") == 1
    start = F.when(is_lot, F.col("_a") - F.col("opened")).otherwise(F.col("_f") - F.col("asked") - before)
    stop = F.when(is_lot, F.col("_a")).otherwise(F.col("_f") - F.greatest(before, F.col("_over")))
    return lost.withColumns({"start": start, "stop": stop}).drop("_a", "_f", "_over", "_lost", "_chunk").where("stop > start")


def _met(tiles: DataFrame, scan: Callable[..., DataFrame]) -> DataFrame:
    """The latest lot and fill at each start of an interval."""
    lot = F.struct(F.col("id").alias("position_id"), F.col("ts").alias("entry_time"), F.col("price").alias("entry_price"), F.col("note").alias("side"), F.col("opened").alias("size"))
    fill = F.struct(F.col("id").alias("fill_id"), "ts", "price", F.col("note").alias("reason"))
    measures = [
        Measure("_lot", "last", F.when(F.col("seq") == 1, F.struct(lot.alias("lot"), "stop"))),
        Measure("_fill", "last", F.when(F.col("seq") == 0, F.struct(fill.alias("fill"), "stop"))),
    ]
    return scan(tiles, ["start", "seq", "id"], measures)


def match_closes(lots: DataFrame, fills: DataFrame, keys: Sequence[str] = ("portfolio", "symbol"), layout: Layout = LAYOUT) -> DataFrame:
    """``(keys, lot, fill, matched, remaining_size)``: how much of which lot each fill closes, first opened first.

    ``lots(keys, position_id, entry_time, entry_price, side, size)``, ``fills(keys, fill_id, ts, price, reason, size)``; with
    ``keys=("portfolio", "position_id")`` a fill closes the position it names. Sizes that are null or not above 0 are passed
    over, what a fill asks beyond the open size is lost. ``position_id`` and ``fill_id`` are unique strings per key.

    Lots and fills both tile the scale of cumulative size. At each start of an interval the latest lot and the latest fill
    overlap up to the nearer stop; so matches are at most as many as lots and fills, and no pairs are formed.

    Keys of up to ``layout.chunk_rows`` rows are shuffled once, each to one task; larger ones are cut by counting.
    """
    keys = list(keys)
    own = [c for c in keys if c != "position_id"]
    rows = _events(lots, fills, keys)
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > layout.chunk_rows).drop("_n"))

    def whole(df: DataFrame, order: list[str], measures: list[Measure], exclusive: bool = False) -> DataFrame:
        return running_whole(df, keys, order, measures, exclusive)

    def cut(df: DataFrame, order: list[str], measures: list[Measure], exclusive: bool = False) -> DataFrame:
        return running(df, keys, "_chunk", order, measures, layout, exclusive=exclusive)

    if large.isEmpty():
        met = _met(_intervals(rows, whole), whole)
    else:
        # a large key has many rows, so there are few of them
        rest = rows.join(F.broadcast(large), keys, "left_anti")
        dealt = depth_chunks(rows.join(F.broadcast(large), keys, "left_semi"), keys, ["ts", "seq", "id"], layout=layout)
        tiles = depth_chunks(_intervals(dealt, cut), keys, ["start", "seq", "id"], layout=layout)
        met = _met(_intervals(rest, whole), whole).unionByName(_met(tiles, cut).drop("_chunk"))
    end = F.least("_lot.stop", "_fill.stop")
    out = met.where(F.col("_lot").isNotNull() & F.col("_fill").isNotNull()).select(
        *own, F.col("_lot.lot").alias("lot"), F.col("_fill.fill").alias("fill"), (end - F.col("start")).alias("matched"), (F.col("_lot.stop") - end).alias("remaining_size")
    )
    return out.where(F.col("matched") > DUST)


def _flat(column: Column) -> Column:
    return F.when(column > DUST, column).otherwise(F.lit(0.0))


def partial_closes(
    lots: DataFrame, fills: DataFrame, keys: Sequence[str] = ("portfolio", "symbol"), signed: bool = False, layout: Layout = LAYOUT
) -> DataFrame:
    """Trade rows, one per lot and fill that closes a part of it: ``size`` is the closed part, ``remaining_size`` what is left of the lot."""
    own = [c for c in keys if c != "position_id"]
    matched = match_closes(lots, fills, keys, layout)
    rows = matched.select(
        *own,
        "lot.side", "lot.position_id", "fill.fill_id", "lot.entry_time", F.col("fill.ts").alias("exit_time"),
        "lot.entry_price", F.col("fill.price").alias("exit_price"), F.col("matched").alias("size"), _flat(F.col("remaining_size")).alias("remaining_size"),
        F.col("fill.reason").alias("exit_reason"),
    )
    return rows.withColumns(trade_columns(signed))


def open_lots(lots: DataFrame, closes: DataFrame) -> DataFrame:
    """``lots`` that are not closed wholly, with ``remaining_size``."""
    gone = closes.groupBy("position_id").agg(F.sum("size").alias("_closed"))
    left = lots.join(gone, "position_id", "left").withColumn("remaining_size", F.col("size") - F.coalesce("_closed", F.lit(0.0)))
    return left.where(F.col("remaining_size") > DUST).drop("_closed")
