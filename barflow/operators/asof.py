"""As-of backward join and timeline reindexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.operators.series import DAY_US, Measure, chunk_running, join_per_key, running


def asof_backward(
    left: DataFrame,
    source: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    timeframe_us: int = DAY_US,
    on_grid: bool = False,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """``left`` + the ``values`` of the last source row at or before its time.

    A NULL in the matched row stays NULL; rows before the first source row get NULL; the row
    count of ``left`` is kept. With empty ``keys`` one market-wide source serves every symbol.

    Left times and source rows are merged into one timeline that is scanned in time chunks.
    ``on_grid`` says that left times are multiples of the timeframe: then only the last source
    row per interval is kept first, and a chunk of ``chunk_bars`` intervals is bounded whatever
    the tick density of the source. Otherwise a chunk is a single interval.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(v) for v in values])
    moments = source.select(*keys, F.unix_micros(ts).alias("_us"), payload.alias("_row"))
    if on_grid:
        step = F.lit(timeframe_us)
        moments = (
            moments.groupBy(*keys, (F.ceil(F.col("_us") / step) * step).cast("bigint").alias("_at"))
            .agg(F.max_by("_row", "_us").alias("_row"))
            .withColumnRenamed("_at", "_us")
        )
    # With keys, the left rows ride through the scan; a keyless source is asked once per moment,
    # so that the bars of all symbols never meet in one chunk.
    asked = left.select(*keys, F.unix_micros(ts).alias("_us"), F.struct("*").alias("_left")) if keys else (
        left.select(F.unix_micros(ts).alias("_us")).distinct()
    )
    line = moments.withColumn("_ask", F.lit(0)).unionByName(
        asked.withColumn("_ask", F.lit(1)), allowMissingColumns=True
    )
    width = timeframe_us * (layout.chunk_bars if on_grid else 1)
    line = line.withColumn("_chunk", F.floor(F.col("_us") / width).cast("bigint"))
    scanned = [Measure("_last", "last", F.col("_row"))]
    answers = running(line, keys, "_chunk", ["_us", "_ask"], scanned, layout).where(F.col("_ask") == 1)
    found = [F.col(f"_last.{v}").alias(v) for v in values]
    if keys:
        return answers.select("_left.*", *found)
    return left.join(answers.select(F.timestamp_micros("_us").alias(ts), *found), ts, "left")


def align(
    bars: DataFrame,
    funding: DataFrame | None = None,
    open_interest: DataFrame | None = None,
    keys: Sequence[str] = ("symbol",),
    timeframe_us: int = DAY_US,
    on_grid: bool = True,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Bars with forward-filled funding and open interest; a missing source adds no column."""
    out = bars
    for source, column in ((funding, "funding_rate"), (open_interest, "open_interest")):
        if source is not None and not source.isEmpty():
            out = asof_backward(out, source, [column], keys, timeframe_us=timeframe_us, on_grid=on_grid, layout=layout)
    return out


def fill_both_ways(indexed: DataFrame, columns: Sequence[str], layout: Layout = LAYOUT) -> DataFrame:
    """Forward fill, then backward fill of leading gaps, over the whole series."""
    def boxed(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))

    out = chunk_running(indexed, [Measure(f"_f_{c}", "last", boxed(c)) for c in columns], layout=layout)
    # Only bars before the first known value need the first one: a single row per symbol.
    firsts = indexed.groupBy("symbol").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("bar_idx"))).alias(f"_b_{c}") for c in columns]
    )
    out = join_per_key(out, firsts, ["symbol"], how="left")
    return out.withColumns({c: F.coalesce(F.col(f"_f_{c}.v"), F.col(f"_b_{c}")) for c in columns}).drop(
        *[f"{p}{c}" for c in columns for p in ("_f_", "_b_")]
    )


def reindex_to(timeline: DataFrame, values: DataFrame, columns: Sequence[str], layout: Layout = LAYOUT) -> DataFrame:
    """Bring ``values`` onto the indexed timeline by time, then fill both ways."""
    joined = timeline.join(values.select("symbol", "ts", *columns), ["symbol", "ts"], "left")
    return fill_both_ways(joined, columns, layout)
