"""Stationary block bootstrap as a distributed resampling job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import LAYOUT, RESEARCH, Layout
from barflow.functions import stats
from barflow.operators.series import Measure, exclusive_scan, with_length


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) that depends on the parts only, so retried tasks agree."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def draw_blocks(
    indexed: DataFrame,
    n_bootstrap: int = 1000,
    block_len: int = RESEARCH.block_len,
    seed: int = 42,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """``(symbol, rep, start, len, source)``: blocks that tile each replicate.

    A position starts a block with probability 1/block_len (the first always does), which gives
    geometric lengths clamped at the end. The source start is uniform over all places where the
    block fits. Replicates multiply the rows of the series where they lie; nothing is shuffled
    until only block starts are left.
    """
    sized = with_length(indexed.select("symbol", "bar_idx"), name="n")
    reps = F.sequence(F.lit(0), F.lit(n_bootstrap - 1))
    spread = sized.select("symbol", "n", F.col("bar_idx").alias("start"), F.explode(reps).alias("rep"))
    draw = hash_uniform(seed, "cut", F.col("symbol"), F.col("rep"), F.col("start"))
    starts = spread.where((F.col("start") == 0) | (draw < 1.0 / block_len)).withColumn(
        "_chunk", F.floor(F.col("start") / layout.chunk_bars).cast("bigint")
    )
    keys = ["symbol", "rep"]
    heads = starts.groupBy(*keys, "_chunk").agg(F.struct(F.min("start").alias("v")).alias("head"))
    after = exclusive_scan(heads, keys, "_chunk", [Measure("head", "last")], layout, levels=1, reverse=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy("start")
    blocks = (
        starts.withColumn("_next", F.lead("start").over(w))
        .join(after, [*keys, "_chunk"], "left")
        .withColumn("len", F.coalesce("_next", F.col("c_head.v"), F.col("n")) - F.col("start"))
    )
    place = hash_uniform(seed, "place", F.col("symbol"), F.col("rep"), F.col("start"))
    source = F.floor(place * (F.col("n") - F.col("len") + 1)).cast("bigint")
    return blocks.select(*keys, "start", "len", source.alias("source"))


def resample(indexed: DataFrame, value: str, blocks: DataFrame, pack: int = 256) -> DataFrame:
    """``(symbol, rep, pos, src_idx, x)``: the long table of resampled values.

    Values are packed in arrays of ``pack`` neighbours, so a block meets one or two rows instead of one per value, and
    what is aggregated by replicate afterwards is combined before it is shuffled.
    """
    part = F.floor(F.col("bar_idx") / pack).cast("bigint")
    cells = F.array_sort(F.collect_list(F.struct("bar_idx", F.col(value).alias("x"))))
    packed = indexed.groupBy("symbol", part.alias("part")).agg(cells.alias("cells"))
    last = F.col("source") + F.col("len") - 1
    pieces = blocks.withColumn("part", F.explode(F.sequence(F.floor(F.col("source") / pack).cast("bigint"), F.floor(last / pack).cast("bigint"))))
    low = F.greatest(F.col("source"), F.col("part") * pack)
    high = F.least(last, F.col("part") * pack + pack - 1)
    taken = F.slice("cells", (low - F.col("part") * pack + 1).cast("int"), (high - low + 1).cast("int"))
    found = pieces.join(packed, ["symbol", "part"]).select("symbol", "rep", (F.col("start") - F.col("source")).alias("shift"), F.explode(taken).alias("cell"))
    return found.select("symbol", "rep", (F.col("shift") + F.col("cell.bar_idx")).alias("pos"), F.col("cell.bar_idx").alias("src_idx"), F.col("cell.x").alias("x"))


def bootstrap_statistic(
    indexed: DataFrame,
    value: str,
    statistic: Callable[[Column], Column],
    n_bootstrap: int = 1000,
    block_len: int = RESEARCH.block_len,
    seed: int = 42,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """``(symbol, rep, stat)`` for any aggregate expression of the resampled values."""
    blocks = draw_blocks(indexed, n_bootstrap, block_len, seed, layout)
    return resample(indexed, value, blocks).groupBy("symbol", "rep").agg(statistic(F.col("x")).alias("stat"))


def confidence_interval(
    indexed: DataFrame,
    value: str,
    statistic: Callable[[Column], Column],
    confidence: float = 0.95,
    **options,
) -> DataFrame:
    """``(symbol, observed, ci_lower, ci_upper, p_value)``. A replicate is one row by then."""
    tail = (1.0 - confidence) / 2.0
    drawn = bootstrap_statistic(indexed, value, statistic, **options)
    observed = indexed.groupBy("symbol").agg(statistic(F.col(value)).alias("observed"))
    at = F.percentile(F.col("stat"), F.array(F.lit(tail), F.lit(1.0 - tail)))
    beyond = F.avg((F.abs(F.col("stat")) >= F.abs(F.col("observed"))).cast("double"))
    return (
        drawn.join(observed, "symbol")
        .groupBy("symbol", "observed")
        .agg(at.alias("_ci"), beyond.alias("p_value"))
        .select(
            "symbol", "observed", F.get("_ci", F.lit(0)).alias("ci_lower"), F.get("_ci", F.lit(1)).alias("ci_upper"), "p_value"
        )
    )


def bootstrap_sharpe(indexed: DataFrame, value: str, **options) -> DataFrame:
    return confidence_interval(indexed, value, lambda x: stats.sharpe(x, periods=None), **options)
