"""Trade-log features and retrain cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import LAYOUT, LIVE, Layout
from barflow.operators.series import DAY_US, Measure, depth_chunks, index_bars, running, with_length
from barflow.schemas import TRADE_FEATURES
from barflow.session import cut_lineage


def parse_exit_times(trades: DataFrame) -> DataFrame:
    """Text times become timestamps; rows whose exit time does not parse are dropped."""
    return trades.withColumn("exit_time", F.try_to_timestamp(F.col("exit_time"))).where(F.col("exit_time").isNotNull())


def trailing_trade_features(
    bars: DataFrame,
    trades: DataFrame | None,
    days: int = LIVE.trade_lookback_days,
    by_symbol: bool = True,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Per bar: count, win rate, mean and deviation of P&L over trades that ended in the last
    ``days`` days, both ends included. NULL throughout when there is no trade log.

    Time is cut into blocks as long as the look-back: a bar's trades are those of its own block up to it and those of the
    block before from its first moment on. So a bar reads one prefix and one suffix sum, and nothing is subtracted. Trades
    of one moment are summed first; blocks are scanned in chunks cut by counting, so no task holds a symbol's busy day.
    """
    if trades is None or trades.isEmpty():
        return bars.withColumns({c: F.lit(None).cast("double") for c in TRADE_FEATURES})
    span = days * DAY_US
    keys = ["symbol"] if by_symbol else []
    # NaN is a missing value
    ended = trades.where(F.col("exit_time").isNotNull()).withColumn("pnl_usd", F.when(~F.isnan("pnl_usd"), F.col("pnl_usd")))
    middle = ended.agg(F.coalesce(F.avg("pnl_usd"), F.lit(0.0))).first()[0]  # keeps squares small
    pnl = F.col("pnl_usd") - middle
    moments = ended.groupBy(*keys, F.unix_micros("exit_time").alias("_us")).agg(
        F.count("pnl_usd").alias("_n"), F.count_if(F.col("pnl_usd") > 0).alias("_wins"), F.sum(pnl).alias("_s"), F.sum(pnl * pnl).alias("_ss")
    )
    asked = cut_lineage(bars.select(*keys, F.unix_micros("ts").alias("_bar")).distinct())
    answers = _edge_sums(moments, asked, keys, span, False, layout).unionByName(_edge_sums(moments, asked, keys, span, True, layout))
    n, s = F.sum("_n"), F.sum("_s")
    counted = answers.groupBy(*keys, "_bar").agg(n.alias("_n"), F.sum("_wins").alias("_wins"), s.alias("_s"), F.sum("_ss").alias("_ss"))
    spread = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")
    spread = F.when(spread > F.col("_ss") * 1e-14, spread).otherwise(F.lit(0.0))  # below that it is rounding
    columns = {
        "trade_count_30d": F.col("_n").cast("double"),
        "rolling_win_rate": F.coalesce(F.try_divide("_wins", "_n"), F.lit(0.0)),
        "rolling_avg_pnl": F.when(F.col("_n") > 0, F.lit(middle) + F.try_divide("_s", "_n")).otherwise(F.lit(0.0)),
        "rolling_volatility": F.when(F.col("_n") > 1, F.sqrt(F.try_divide(spread, F.col("_n") - 1))).otherwise(F.lit(0.0)),
    }
    told = counted.select(*keys, F.timestamp_micros("_bar").alias("ts"), *[c.alias(name) for name, c in columns.items()])
    return bars.join(told, [*keys, "ts"])


def _edge_sums(moments: DataFrame, asked: DataFrame, keys: list[str], span: int, suffix: bool, layout: Layout) -> DataFrame:
    """``(keys, _bar, _n, _wins, _s, _ss)``: sums of a bar's block up to the bar, or of the block before from ``span`` ago on."""
    names = ["_n", "_wins", "_s", "_ss"]
    shift = span if suffix else 0
    # at one moment the bar is read after the trades, in the direction of the scan
    own = asked.select(*keys, "_bar", ((F.col("_bar") - shift) * 2 + (0 if suffix else 1)).alias("_at"))
    line = moments.withColumn("_at", F.col("_us") * 2 + (1 if suffix else 0)).drop("_us").unionByName(own, allowMissingColumns=True)
    line = line.withColumn("_era", F.floor(F.shiftright("_at", 1) / span).cast("bigint"))
    dealt = depth_chunks(line, [*keys, "_era"], ["_at"], layout=layout)
    measures = [Measure(f"t{c}", "sum", F.coalesce(F.col(c), F.lit(0))) for c in names]
    summed = running(dealt, [*keys, "_era"], "_chunk", ["_at"], measures, layout, reverse=suffix)
    return summed.where(F.col("_bar").isNotNull()).select(*keys, "_bar", *[F.col(f"t{c}").alias(c) for c in names])


def retrain_due(counts: DataFrame, last: DataFrame, every: int = LIVE.retrain_every, key: str = "portfolio") -> DataFrame:
    """Milestone per portfolio: largest multiple of ``every`` reached, due if beyond the last one."""
    reached = (F.floor(F.col("total_trades") / every) * every).cast("bigint")
    done = F.coalesce("last_trigger", F.lit(0)).cast("bigint")
    joined = counts.join(last.select(key, "last_trigger"), key, "left")
    return joined.select(
        key, "total_trades", reached.alias("milestone"), ((reached > done) & (reached > 0)).alias("due")
    )


def training_rows(features: DataFrame, label: str = "label", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL among features and label."""
    return features.dropna("any", subset=[*columns, label] if columns else None)


def enough_samples(labelled: DataFrame, minimum: int = LIVE.min_samples) -> DataFrame:
    """Symbols with at least ``minimum`` labelled rows."""
    return labelled.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)


def require_samples(labelled: DataFrame, minimum: int = LIVE.min_samples) -> int:
    n = labelled.count()
    if n < minimum:
        raise ValueError(f"not enough samples: {n} < {minimum}")
    return n


def last_bars(indexed: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` bars per symbol, by position rather than by a sort of the whole symbol."""
    return with_length(indexed).where(F.col("bar_idx") >= F.col("n_bars") - n).drop("n_bars")


def latest_bar(bars: DataFrame) -> DataFrame:
    """Newest bar per symbol. One aggregate per column keeps the buffers fixed-width and hashed."""
    others = [c for c in bars.columns if c not in ("symbol", "ts")]
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in others])
    return newest.select(*bars.columns)


def rolling_train_window(
    labelled: DataFrame,
    window: int = LIVE.train_window,
    every: int = LIVE.retrain_every,
    timeframe_us: int = DAY_US,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Labelled rows + ``row_idx`` (position among labelled rows), ``in_window`` (belongs to the
    newest ``window`` rows) and ``retrain`` (``every`` rows have passed since the last training)."""
    numbered = index_bars(labelled.drop("bar_idx"), timeframe_us=timeframe_us, layout=layout)
    sized = with_length(numbered)
    return sized.select(
        *[c for c in sized.columns if c not in ("bar_idx", "n_bars")],
        F.col("bar_idx").alias("row_idx"),
        (F.col("bar_idx") >= F.col("n_bars") - window).alias("in_window"),
        (F.col("bar_idx") % every == 0).alias("retrain"),
    )
