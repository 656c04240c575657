"""Removal of label windows that lie inside another window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.operators.series import DAY_US, Measure, exclusive_scan


def purge_contained(
    windows: DataFrame,
    start: str | None = "entry_time",
    end: str | None = "exit_time",
    keys: Sequence[str] = ("symbol",),
    timeframe_us: int = DAY_US,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Add ``clean``: False iff another window covers this one with at least one strict bound.

    Identical windows all stay. Without window columns every row is clean. Instead of comparing
    pairs: a window is covered iff the latest end among earlier starts reaches its end, or the
    latest end among equal starts passes it. Ends are first reduced to one row per start.
    """
    if start is None or end is None:
        return windows.withColumn("clean", F.lit(True))
    keys = list(keys)
    spans = windows.select(*keys, F.unix_micros(start).alias("_s"), F.unix_micros(end).alias("_e"))
    per_start = spans.groupBy(*keys, "_s").agg(F.max("_e").alias("_same")).withColumn(
        "_chunk", F.floor(F.col("_s") / (timeframe_us * layout.chunk_bars)).cast("bigint")
    )
    totals = per_start.groupBy(*keys, "_chunk").agg(F.max("_same").alias("m"))
    carry = exclusive_scan(totals, keys, "_chunk", [Measure("m", "max")], layout)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        per_start.withColumn("_local", F.max("_same").over(w))
        .join(carry, [*keys, "_chunk"], "left")
        .select(*keys, "_s", "_same", F.greatest("_local", "c_m").alias("_before"))
    )
    flagged = windows.withColumns({"_s": F.unix_micros(start), "_e": F.unix_micros(end)}).join(
        before, [*keys, "_s"], "left"
    )
    covered = F.coalesce(F.col("_before") >= F.col("_e"), F.lit(False)) | (F.col("_same") > F.col("_e"))
    return flagged.withColumn("clean", ~covered).drop("_s", "_e", "_before", "_same")
