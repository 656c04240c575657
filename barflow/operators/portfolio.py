"""Positions, cash, exposure and daily results as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import LAYOUT, LIVE, Layout
from barflow.functions.signals import entry_size
from barflow.operators.series import Measure, depth_chunks, exclusive_scan, running


def open_from_signals(signals: DataFrame, cash: Column, cfg=LIVE) -> DataFrame:
    """BUY rows of ``(symbol, ts, bar_idx, signal, price, tp_price, sl_price)`` as positions."""
    return signals.where(F.col("signal") == "BUY").select(
        "symbol",
        F.concat_ws("_", "symbol", "bar_idx").alias("position_id"),
        F.lit("BUY").alias("side"),
        F.col("bar_idx").alias("entry_idx"),
        F.col("ts").alias("entry_time"),
        F.col("price").alias("entry_price"),
        entry_size(cash, F.col("price"), cfg.position_fraction).alias("size"),
        "tp_price",
        "sl_price",
    )


def admit(signals: DataFrame, open_positions: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """BUY signals of symbols without an open position; with ``cash(portfolio, cash_usd)`` also
    those the portfolio can pay for."""
    buys = signals.where(F.col("signal") == "BUY")
    free = buys.join(open_positions.select("symbol").distinct(), "symbol", "left_anti")
    return free if cash is None else affordable(free, cash)


def affordable(orders: DataFrame, cash: DataFrame) -> DataFrame:
    """Orders whose notional does not exceed the cash of their portfolio."""
    return orders.join(cash.select("portfolio", "cash_usd"), "portfolio").where(
        F.col("price") * F.col("size") <= F.col("cash_usd")
    )


def require_cash(orders: DataFrame, cash: DataFrame) -> DataFrame:
    """The strict variant: an order beyond the cash of its portfolio is an error."""
    short = F.col("price") * F.col("size") > F.col("cash_usd")
    message = F.format_string("Insufficient cash: need $%.2f, have $%.2f", F.col("price") * F.col("size"), F.col("cash_usd"))
    checked = F.when(short, F.raise_error(message).cast("double")).otherwise(F.col("cash_usd"))
    return orders.join(cash.select("portfolio", "cash_usd"), "portfolio").withColumn("cash_usd", checked)


def trade_columns(signed: bool = False) -> dict[str, Column]:
    """P&L and return of a closed position. ``signed`` reverses both for SELL (research variant)."""
    move = F.col("exit_price") - F.col("entry_price")
    percent = (F.try_divide("exit_price", "entry_price") - 1.0) * 100.0
    if signed:
        flip = F.when(F.col("side") == "SELL", F.lit(-1.0)).otherwise(F.lit(1.0))
        move, percent = move * flip, percent * flip
    return {"pnl_usd": move * F.col("size"), "return_pct": percent}


def closed_trades(positions: DataFrame, signed: bool = False) -> DataFrame:
    """Positions with an exit -> trade rows."""
    return positions.where(F.col("exit_price").isNotNull()).withColumns(trade_columns(signed))


def latest_prices(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("symbol").agg(F.max_by("close", "ts").alias("mark"), F.max("ts").alias("mark_ts"))


def mark_to_market(positions: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """``(portfolio, cash_usd, position_value, equity_usd)``; positions without a price use their entry."""
    value = F.sum(F.coalesce("mark", "entry_price") * F.col("size"))
    held = positions.join(prices.select("symbol", "mark"), "symbol", "left").groupBy("portfolio").agg(
        value.alias("position_value"), F.count(F.lit(1)).alias("open_positions")
    )
    worth = F.coalesce("position_value", F.lit(0.0))
    return cash.join(held, "portfolio", "left").select(
        "portfolio",
        "cash_usd",
        worth.alias("position_value"),
        (F.col("cash_usd") + worth).alias("equity_usd"),
        F.coalesce("open_positions", F.lit(0)).cast("bigint").alias("open_positions"),
    )


def portfolio_heat(positions: DataFrame, equity: DataFrame) -> DataFrame:
    """Share of equity held at entry prices; 0 without positions or equity."""
    held = positions.groupBy("portfolio").agg(F.sum(F.abs(F.col("entry_price") * F.col("size"))).alias("exposure"))
    heat = F.when(F.col("equity_usd") > 0, F.col("exposure") / F.col("equity_usd"))
    return equity.join(held, "portfolio", "left").select("portfolio", F.coalesce(heat, F.lit(0.0)).alias("heat"))


def cash_flows(positions: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """Opening and closing flows. At one time closings come first, then ids in order.

    A position closes as a whole at its exit, or in the parts that ``closes`` lists (see ``closes.partial_closes``).
    """
    opened = positions.select(
        "portfolio",
        F.col("entry_time").alias("ts"),
        F.lit(1).alias("seq"),
        "position_id",
        (-F.col("entry_price") * F.col("size")).alias("flow"),
        (F.col("entry_price") * F.col("size")).alias("exposure_change"),
    )
    whole = positions.where(F.col("exit_price").isNotNull()) if closes is None else closes
    closed = whole.select(
        "portfolio",
        F.col("exit_time").alias("ts"),
        F.lit(0).alias("seq"),
        "position_id",
        (F.col("exit_price") * F.col("size")).alias("flow"),
        (-F.col("entry_price") * F.col("size")).alias("exposure_change"),
        *([] if closes is None else ["fill_id", "remaining_size"]),
    )
    return opened.unionByName(closed, allowMissingColumns=True)


def cash_ledger(
    positions: DataFrame, starting_cash: float = LIVE.starting_cash, layout: Layout = LAYOUT, closes: DataFrame | None = None
) -> DataFrame:
    """Running cash and open exposure after every flow of a portfolio.

    Flows are scanned in chunks of ``layout.chunk_rows``, cut by counting, so that a portfolio with any number of flows at
    one time is split as well.
    """
    flows = cash_flows(positions, closes)
    order = ["ts", "seq", "position_id"]
    if closes is not None:
        flows = flows.withColumn("fill_id", F.coalesce("fill_id", F.lit("")))
        order.append("fill_id")
    out = running(
        depth_chunks(flows, ["portfolio"], order, layout=layout),
        ["portfolio"],
        "_chunk",
        order,
        [Measure("_cash", "sum", F.col("flow")), Measure("exposure", "sum", F.col("exposure_change"))],
        layout,
    )
    return out.withColumn("cash_usd", F.col("_cash") + starting_cash).drop("_cash", "_chunk", "exposure_change")


def daily_results(
    trades: DataFrame, starting_cash: float = LIVE.starting_cash, layout: Layout = LAYOUT
) -> DataFrame:
    """Realized P&L per portfolio and exit day, with the equity the day started from."""
    days = trades.groupBy("portfolio", F.to_date("exit_time").alias("day")).agg(
        F.sum("pnl_usd").alias("daily_pnl"), F.count(F.lit(1)).alias("n_trades")
    )
    numbered = days.withColumn("_pos", F.unix_date("day").cast("bigint"))
    before = exclusive_scan(
        numbered.select("portfolio", "_pos", F.col("daily_pnl").alias("p")), ["portfolio"], "_pos", [Measure("p", "sum")], layout
    )
    return numbered.join(before, ["portfolio", "_pos"]).select(
        "portfolio",
        "day",
        "daily_pnl",
        "n_trades",
        (F.coalesce("c_p", F.lit(0.0)) + starting_cash).alias("daily_start_equity"),
    )


def trade_counts(trades: DataFrame, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    wins = F.count_if(F.col("pnl_usd") > 0)
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        wins.alias("winning_trades"),
        F.coalesce(F.try_divide(wins, F.count(F.lit(1))), F.lit(0.0)).alias("win_rate"),
    )


def snapshots(
    accounts: DataFrame,
    positions: DataFrame,
    prices: DataFrame,
    trades: DataFrame,
    starting_cash: float = LIVE.starting_cash,
) -> DataFrame:
    """One live row per (portfolio, symbol) account with its position fields or defaults.

    ``accounts(portfolio, symbol, cash_usd)``, ``positions`` are the open ones. Equity counts
    the position of the symbol only.
    """
    first = positions.groupBy("portfolio", "symbol").agg(
        F.min_by(F.struct("side", "size", "entry_price", "tp_price", "sl_price", "bars_held"), F.struct("entry_time", "position_id")).alias("p")
    )
    opened = positions.groupBy("portfolio").agg(F.count(F.lit(1)).alias("open_positions"))
    joined = (
        accounts.join(prices.select("symbol", "mark", "mark_ts"), "symbol", "left")
        .join(first, ["portfolio", "symbol"], "left")
        .join(opened, "portfolio", "left")
        .join(trade_counts(trades), "portfolio", "left")
    )
    has = F.col("p").isNotNull()

    def field(name: str, empty) -> Column:
        return F.when(has, F.col(f"p.{name}")).otherwise(F.lit(empty)).alias(f"position_{name}")

    worth = F.when(has, F.col("p.size") * F.coalesce("mark", "p.entry_price")).otherwise(F.lit(0.0))
    return joined.select(
        "portfolio",
        F.col("mark_ts").alias("timestamp"),
        "cash_usd",
        (F.col("cash_usd") + worth).alias("equity_usd"),
        F.lit(starting_cash).alias("starting_cash_usd"),
        F.coalesce("open_positions", F.lit(0)).cast("bigint").alias("open_positions"),
        F.when(has, F.col("symbol")).otherwise(F.lit("")).alias("position_symbol"),
        field("side", ""),
        field("size", 0.0),
        field("entry_price", 0.0),
        field("tp_price", 0.0),
        field("sl_price", 0.0),
        field("bars_held", 0),
        F.coalesce("total_trades", F.lit(0)).cast("bigint").alias("total_trades"),
        F.coalesce("winning_trades", F.lit(0)).cast("bigint").alias("winning_trades"),
        F.round(F.coalesce("win_rate", F.lit(0.0)), 4).alias("win_rate"),
    )


def latest_snapshot(rows: DataFrame, key: str = "portfolio", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The last row per portfolio replaces earlier ones; ``order`` must be unique per portfolio."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")
