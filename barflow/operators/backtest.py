"""Cost-aware backtest of a signal series."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, RESEARCH, Layout, ResearchConfig
from barflow.functions import stats
from barflow.operators.series import LocalOp, Measure, apply_local, chunk_running
from barflow.session import cut_lineage


def slippage(size: Column, vma: Column, k: float = RESEARCH.slippage_k) -> Column:
    """Square-root impact; 0 where no average volume is known to be positive."""
    return F.when(vma > 0, k * F.sqrt(F.abs(size) / F.nullif(vma, F.lit(0.0)))).otherwise(F.lit(0.0))


def net_return_op(cfg: ResearchConfig = RESEARCH) -> LocalOp:
    """``position, gross, turnover, cost, net, active`` from ``signal, close, vma, size``.

    The position of a bar is the signal of the bar before. Gross returns are fractions, costs
    are in currency and are subtracted as they are.
    """

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("signal", F.coalesce(F.col("signal"), F.lit(0)))
        earlier = F.lag("signal").over(w)
        move = F.try_divide("close", F.lag("close").over(w)) - 1.0
        df = df.withColumns(
            {
                "position": F.coalesce(earlier, F.lit(0)),
                "turnover": F.coalesce(F.abs(F.col("signal") - earlier), F.lit(0)).cast("double"),
                "active": F.coalesce(earlier, F.lit(1)) != 0,
                "_move": F.coalesce(move, F.lit(0.0)),
            }
        )
        df = df.withColumn("gross", F.col("_move") * F.col("position")).drop("_move")
        fees = F.col("turnover") * F.col("size") * F.col("close") * (cfg.taker_fee + cfg.maker_fee)
        impact = slippage(F.col("size"), F.col("vma"), cfg.slippage_k) * F.col("turnover")
        df = df.withColumn("cost", fees + impact)
        return df.withColumn("net", F.col("gross") - F.col("cost"))

    return LocalOp(1, 0, apply)


def equity_curve(series: DataFrame, cfg: ResearchConfig = RESEARCH, layout: Layout = LAYOUT) -> DataFrame:
    """Indexed series with ``signal, close, vma, size`` -> net returns and ``equity``."""
    net = apply_local(series, net_return_op(cfg), layout=layout)
    grown = chunk_running(net, [Measure("_growth", "product", 1.0 + F.col("net"))], layout=layout)
    return grown.withColumn("equity", F.col("_growth") * cfg.initial_capital).drop("_growth")


def drawdown(curve: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Adds ``peak`` and ``drawdown`` (zero or negative fraction)."""
    out = chunk_running(curve, [Measure("peak", "max", F.col("equity"))], layout=layout)
    return out.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))


def summarize(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per strategy from an equity curve with drawdowns; all aggregates combine map-side."""
    net = F.col("net")
    active = F.count_if(F.col("active"))
    out = curve.groupBy(*keys).agg(
        (F.max_by("equity", "bar_idx") / F.min_by("equity", "bar_idx") - 1.0).alias("total_return"),
        stats.sharpe(net).alias("sharpe_ratio"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
        F.floor(F.sum("turnover") / 2).cast("bigint").alias("total_trades"),
        F.coalesce(F.try_divide(F.count_if(F.col("active") & (net > 0)), active), F.lit(0.0)).alias("win_rate"),
        F.sum("cost").alias("cost_usd"),
        stats.unbiased_skew(net).alias("skew"),
        stats.unbiased_kurtosis(net).alias("kurtosis"),
        F.count(net).alias("n_bars"),
    )
    spread = F.when(F.col("sharpe_ratio") > 0, F.col("sharpe_ratio") / F.sqrt("n_bars")).otherwise(F.lit(0.01))
    return out.withColumn(
        "dsr_z",
        stats.deflated_sharpe_z(
            F.col("sharpe_ratio"), F.col("n_bars"), spread, F.col("skew"), F.col("kurtosis")
        ),
    )


def run_backtest(series: DataFrame, cfg: ResearchConfig = RESEARCH, layout: Layout = LAYOUT) -> tuple[DataFrame, DataFrame]:
    """(summary, equity curve). The curve is an output of its own and is written once."""
    curve = cut_lineage(equity_curve(series, cfg, layout))
    summary = summarize(drawdown(curve, layout))
    return summary.withColumn("deflated_sharpe", stats.normal_cdf("dsr_z")), curve
