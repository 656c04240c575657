"""Signals, sizing, gates, positions, statistics: hand values and boundaries."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.config import RESEARCH, Layout
from barflow.functions import microstructure, risk, signals, sizing, stats
from barflow.operators import backtest, bootstrap, cv, portfolio, reconcile, trades

DAY = datetime(2024, 1, 1)
SMALL = Layout(chunk_bars=64, fanout=4)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_signal_floor_costs_and_warmup(spark):
    rows = [(100_000.0, 50.0, 0.9, 0.05, 2000), (100.0, 400.0, 0.9, 0.05, 2000), (100.0, 400.0, 0.9, 0.05, 999), (100.0, 400.0, 0.55, 0.0, 2000)]
    df = spark.createDataFrame(rows, "close double, atr double, p_tp double, p_sl double, n bigint")
    cols = signals.signal_columns(*[F.col(c) for c in ("close", "atr", "p_tp", "p_sl", "n")])
    a, b, c, d = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    assert a.tp_price == 100_250.0 and a.sl_price == 99_950.0
    assert a.edge == pytest.approx(0.9 * 250 - 0.05 * 50 - 2 * (100.0 + 20.0), abs=1e-9)
    assert a.signal == "SIT_OUT" and a.reason is None
    assert b.tp_price == 700.0 and b.signal == "BUY"
    assert (c.signal, c.reason, c.p_tp, c.p_sl, c.p_time, c.edge, c.tp_price) == ("SIT_OUT", "WARMUP", 0.0, 0.0, 1.0, 0.0, 700.0)
    assert d.signal == "SIT_OUT"  # not above the threshold


def test_entry_size(spark):
    out = one(spark, signals.entry_size(F.lit(1000.0), F.lit(50.0)).alias("a"), signals.entry_size(F.lit(1000.0), F.lit(0.0)).alias("b"))
    assert (out.a, out.b) == (2.0, 0.0)


def test_kelly(spark):
    def kelly(p, b, **kw):
        return one(spark, sizing.fractional_kelly(F.lit(p), F.lit(b), **kw).alias("f")).f

    assert kelly(0.6, 1.0) == pytest.approx(0.05)  # a quarter of 0.2
    assert kelly(0.5, 1.0) == 0.0
    assert kelly(0.3, 1.0) == 0.0
    assert kelly(0.9, 2.0) == RESEARCH.kelly_cap
    assert kelly(0.55, 1.0, kelly_fraction=0.1) == pytest.approx(0.01)
    assert kelly(1.0, 1.0) is None and kelly(0.5, 0.0) is None
    with pytest.raises(Exception, match="win_loss_ratio must be > 0"):
        kelly(0.5, 0.0, strict=True)
    with pytest.raises(Exception, match="win_prob must be between 0 and 1"):
        kelly(1.0, 1.0, strict=True)


def test_kelly_units(spark):
    def units(f, eq, price, **kw):
        return one(spark, sizing.kelly_units(F.lit(f), F.lit(eq), F.lit(price), **kw).alias("u")).u

    assert units(0.02, 10_000.0, 100.0) == pytest.approx(2.0)
    assert units(0.5, 10_000.0, 100.0) == pytest.approx(5.0)  # capped at 5 %
    assert units(0.0001, 10_000.0, 100.0) == 0.0  # below the minimum
    assert units(0.02, 0.0, 100.0) == 0.0 and units(0.02, 100.0, 0.0) == 0.0


def test_gates(spark):
    def run(gate):
        out = one(spark, gate.alias("g")).g
        return out.ok, out.reason

    assert run(risk.drawdown_gate(F.lit(9_700.0), F.lit(10_000.0)))[0] is False  # exactly the limit blocks
    assert run(risk.drawdown_gate(F.lit(9_701.0), F.lit(10_000.0))) == (True, "ok")
    assert run(risk.drawdown_gate(F.lit(1.0), F.lit(0.0))) == (True, "start_equity_zero")
    assert run(risk.drawdown_gate(F.lit(9_000.0), F.lit(10_000.0)))[1] == "daily_drawdown 10.00% >= limit 3.00%"
    assert run(risk.exposure_gate(F.lit(3_000.0), F.lit(2_000.0), F.lit(10_000.0))) == (True, "ok")  # exactly the limit passes
    assert run(risk.exposure_gate(F.lit(3_000.0), F.lit(2_001.0), F.lit(10_000.0)))[0] is False
    assert run(risk.exposure_gate(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == (False, "equity_zero")
    assert run(risk.notional_gate(F.lit(1.0), F.lit(5.0))) == (True, "ok")
    assert run(risk.notional_gate(F.lit(1.0), F.lit(-4.0))) == (False, "notional 4.00 < minimum 5.00")
    both = one(spark, risk.risk_gate(F.lit(9_000.0), F.lit(10_000.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("g")).g
    assert both.ok is False and [r.split()[0] for r in both.reasons] == ["daily_drawdown", "notional"]
    fine = one(spark, risk.risk_gate(F.lit(10_000.0), F.lit(10_000.0), F.lit(0.0), F.lit(10.0), F.lit(1.0)).alias("g")).g
    assert fine.ok is True and fine.reasons == ["ok"]


def test_book_and_flow(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([5.0, 0.0], [0.0, 5.0]), ([0.0], [0.0]), ([3.0], [0.0])], "bids array<double>, asks array<double>")
    out = [r.x for r in df.select(microstructure.book_imbalance(F.col("bids"), F.col("asks")).alias("x")).collect()]
    assert out == [0.0, 0.0, 0.0, 1.0]
    top = [r.x for r in df.select(microstructure.book_imbalance(F.col("bids"), F.col("asks"), 1).alias("x")).collect()]
    assert top == [0.0, 1.0, 0.0, 1.0]
    wide = spark.createDataFrame([(1.0, 2.0, 0.0, 1.0)], "level_0 double, level_1 double, a_0 double, a_1 double")
    folded = microstructure.book_imbalance(microstructure.wide_levels(["level_0", "level_1"]), microstructure.wide_levels(["a_0", "a_1"]))
    assert wide.select(folded.alias("x")).first().x == 0.5
    flow = spark.createDataFrame([("s", DAY, "buy", 3.0), ("s", DAY, "sell", 1.0), ("s", DAY + timedelta(hours=2), "buy", 0.0)], "symbol string, ts timestamp, side string, size double")
    got = {r.ts: r.imbalance for r in microstructure.flow_imbalance(flow, "1 hour").collect()}
    assert got == {DAY: 0.5, DAY + timedelta(hours=2): 0.0}


def test_meta_expressions(spark):
    df = spark.createDataFrame([(1, 1), (-1, 1), (-1, -1), (1, 0), (1, -1)], "p int, y int")
    assert [r.m for r in df.select(signals.meta_label(F.col("p"), F.col("y")).alias("m")).collect()] == [1, 0, 1, 0, 0]
    bets = spark.createDataFrame([(1, 0.8), (1, 0.2), (-1, 0.8), (0, 0.5), (-1, 0.2)], "d int, m double")
    down, up = signals.side_probabilities(F.col("d"), F.col("m"))
    out = bets.select(down.alias("a"), up.alias("b"), signals.gated_bet(down, up).alias("bet")).collect()
    assert all(r.a + r.b == pytest.approx(1.0) for r in out)
    assert [r.bet for r in out] == [1, -1, -1, 1, 1]


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(rng.gamma(2.0, size=300) - 1.5)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = df.agg(stats.unbiased_skew(F.col("x")).alias("s"), stats.unbiased_kurtosis(F.col("x")).alias("k"), stats.sharpe(F.col("x")).alias("r")).first()
    assert out.s == pytest.approx(x.skew()) and out.k == pytest.approx(x.kurtosis())
    assert out.r == pytest.approx(x.mean() / x.std() * math.sqrt(252))
    flat = spark.createDataFrame([(1.0,)] * 9, "x double").agg(stats.unbiased_skew(F.col("x")).alias("s"), stats.unbiased_kurtosis(F.col("x")).alias("k"), stats.sharpe(F.col("x")).alias("r")).first()
    assert (flat.s, flat.k, flat.r) == (0.0, 0.0, 0.0)
    z = spark.createDataFrame([(10,), (1000,)], "n bigint").select(
        stats.normal_cdf(stats.deflated_sharpe_z(F.lit(1.5), F.col("n"), F.lit(0.5), F.lit(0.0), F.lit(3.0))).alias("p")
    ).collect()
    assert 0.0 <= z[1].p < z[0].p <= 1.0  # more trials, less confidence
    cdf = spark.createDataFrame([(0.0,), (1.959963984540054,), (None,)], "z double").select(stats.normal_cdf("z").alias("p")).collect()
    assert cdf[0].p == 0.5 and cdf[1].p == pytest.approx(0.975) and cdf[2].p is None


@pytest.fixture(scope="module")
def strategy(make_bars):
    local, df = make_bars({"hot": 400, "low": 70}, seed=3)
    rng = np.random.default_rng(8)
    local["signal"] = rng.integers(-1, 2, len(local)).astype("float64")
    local.loc[local["bar_idx"] < 10, "signal"] = np.nan
    local["vma"], local["size"] = 50_000.0, 0.01
    return local, df.sparkSession.createDataFrame(local).withColumn("signal", F.nanvl("signal", F.lit(None)).cast("int"))


def test_backtest_against_pandas(strategy):
    local, df = strategy
    summary, curve = backtest.run_backtest(df, layout=SMALL)
    got = {r.symbol: r for r in summary.collect()}
    assert curve.count() == len(local)
    for symbol, g in local.groupby("symbol"):
        g = g.sort_values("bar_idx")
        sig = g["signal"].fillna(0)
        ret = g["close"].pct_change().fillna(0) * sig.shift(1).fillna(0)
        flips = sig.diff().fillna(0).abs()
        cost = flips * 0.01 * g["close"] * 0.0007 + 0.0001 * math.sqrt(0.01 / 50_000) * flips
        net = ret - cost
        eq = (1 + net).cumprod() * 10_000
        active = sig.shift(1) != 0
        r = got[symbol]
        assert r.total_return == pytest.approx(eq.iloc[-1] / eq.iloc[0] - 1)
        assert r.max_drawdown == pytest.approx(abs(((eq - eq.cummax()) / eq.cummax()).min()))
        assert r.total_trades == int(flips.sum() / 2)
        assert r.win_rate == pytest.approx(((net > 0) & active).sum() / active.sum())
        assert r.cost_usd == pytest.approx(cost.sum())
        assert 0.0 <= r.deflated_sharpe <= 1.0


def test_flat_strategy_costs_nothing(strategy):
    _, df = strategy
    summary, _ = backtest.run_backtest(df.withColumn("signal", F.lit(0)), layout=SMALL)
    for r in summary.collect():
        assert (r.cost_usd, r.total_trades, r.total_return, r.sharpe_ratio, r.win_rate) == (0.0, 0, 0.0, 0.0, 0.0)


def test_slippage(spark):
    out = one(spark, backtest.slippage(F.lit(4.0), F.lit(100.0), 0.5).alias("a"), backtest.slippage(F.lit(4.0), F.lit(0.0)).alias("b"))
    assert (out.a, out.b) == (pytest.approx(0.1), 0.0)


def test_bootstrap_tiles_and_interval(spark, make_bars):
    local, df = make_bars({"hot": 300, "low": 40}, seed=2)
    rows = df.select("symbol", "bar_idx", "volume")
    blocks = bootstrap.draw_blocks(rows, 20, 10, 5, SMALL)
    sample = bootstrap.resample(rows, "volume", blocks)
    counts = sample.groupBy("symbol", "rep").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d"), F.min("src_idx").alias("a"), F.max("src_idx").alias("b")).collect()
    assert len(counts) == 40
    for r in counts:
        n = 300 if r.symbol == "hot" else 40
        assert r.n == r.d == n and r.a >= 0 and r.b < n
    mean = blocks.where("symbol = 'hot'").agg(F.avg("len")).first()[0]
    assert 7 < mean < 13
    again = bootstrap.draw_blocks(rows, 20, 10, 5, SMALL)
    assert blocks.exceptAll(again).isEmpty() and again.exceptAll(blocks).isEmpty()
    ci = bootstrap.confidence_interval(rows, "volume", F.avg, n_bootstrap=100, block_len=5, layout=SMALL).collect()
    assert all(r.ci_lower <= r.observed <= r.ci_upper and 0 <= r.p_value <= 1 for r in ci)


def test_folds(make_bars):
    _, df = make_bars({"a": 103, "b": 20})
    roles = cv.purged_folds(df, 5, 3).toPandas()
    test = roles[roles.role == "test"]
    assert len(test) == 123 and not test.duplicated(["symbol", "bar_idx"]).any()
    a = roles[(roles.symbol == "a") & (roles.fold == 1)]
    assert a[a.role == "embargo"]["bar_idx"].tolist() == [40, 41, 42] or sorted(a[a.role == "embargo"]["bar_idx"]) == [40, 41, 42]
    assert sorted(roles[(roles.symbol == "a") & (roles.fold == 4) & (roles.role == "test")]["bar_idx"]) == list(range(80, 103))
    with pytest.raises(ValueError):
        cv.purged_folds(df, 1)
    with pytest.raises(ValueError):
        cv.purged_folds(df, 3, -1)


def test_walk_forward_counts(make_bars):
    _, df = make_bars({"a": 100})
    for step, folds in ((None, 7), (20, 4)):
        out = cv.walk_forward(df, 30, 10, step).toPandas()
        assert out["fold"].nunique() == folds
        sizes = out.groupby(["fold", "role"]).size().unstack()
        assert (sizes["train"] == 30).all() and (sizes["test"] == 10).all()
    assert cv.walk_forward(df, 90, 20).count() == 0


def test_rule_grid(spark, make_bars):
    _, df = make_bars({"a": 50})
    labelled = df.select("symbol", "bar_idx", F.lit(1).alias("label"), (F.col("bar_idx") % 2).alias("x"))
    out = cv.rule_grid(labelled, {"t": [0, 1], "s": [1, -1, 2]}, F.when(F.col("x") >= F.col("t"), F.col("s")).otherwise(F.lit(0)), 5)
    assert out.count() == 6
    best = out.where("t = 0 and s = 1").first()
    assert best.mean_score == 1.0 and best.std_score == 0.0 and best.fold_4 == 1.0


def test_reconcile(spark):
    local = spark.createDataFrame([("BTC", "BUY", 1.0, 10.0), ("ETH", "BUY", 2.0, 20.0), ("SOL", "BUY", 1.0, 5.0)], "symbol string, side string, size double, entry_price double")
    venue = spark.createDataFrame([("BTC", "BUY", 1.0001, 10.0), ("ETH", "BUY", 3.0, 20.0), ("ADA", "SELL", 4.0, 1.0)], "symbol string, side string, size double, entry_price double")
    compared = reconcile.compare_positions(local, venue, step_size=0.001)
    assert {r.symbol: r.status for r in compared.collect()} == {"BTC": "ok", "ETH": "resized", "SOL": "stale", "ADA": "missing"}
    texts = {r.symbol: r.message for r in reconcile.discrepancies(compared).collect()}
    assert texts["SOL"] == "Local position SOL BUY not found on exchange"
    assert texts["ETH"] == "Size mismatch for ETH: local=2.0, exchange=3.0"
    assert texts["ADA"] == "Exchange position ADA SELL missing locally"
    book = {r.symbol: r for r in reconcile.reconciled(compared).collect()}
    assert set(book) == {"BTC", "ETH", "ADA"} and book["ETH"].size == 3.0 and book["BTC"].size == 1.0
    assert book["ADA"].position_id == "recovered_ADA_SELL" and book["ADA"].tp_price == 0.0


def test_equity_uses_entry_without_price(spark):
    held = spark.createDataFrame([("p", "BTC", 100.0, 0.1), ("p", "XYZ", 50.0, 1.0)], "portfolio string, symbol string, entry_price double, size double")
    prices = spark.createDataFrame([("BTC", 200.0)], "symbol string, mark double")
    cash = spark.createDataFrame([("p", 9_940.0), ("q", 5.0)], "portfolio string, cash_usd double")
    out = {r.portfolio: r for r in portfolio.mark_to_market(held, prices, cash).collect()}
    assert out["p"].equity_usd == 10_010.0 and out["q"].equity_usd == 5.0
    heat = {r.portfolio: r.heat for r in portfolio.portfolio_heat(held, portfolio.mark_to_market(held, prices, cash)).collect()}
    assert heat == {"p": pytest.approx(60.0 / 10_010.0), "q": 0.0}


def test_cash_rules(spark):
    orders = spark.createDataFrame([("p", 10.0, 1.0), ("p", 10.0, 2.0)], "portfolio string, price double, size double")
    cash = spark.createDataFrame([("p", 10.0)], "portfolio string, cash_usd double")
    assert portfolio.affordable(orders, cash).count() == 1
    with pytest.raises(Exception, match="Insufficient cash"):
        portfolio.require_cash(orders, cash).collect()


def test_milestones(spark):
    counts = spark.createDataFrame([("a", 99), ("b", 100), ("c", 205), ("d", 205)], "portfolio string, total_trades bigint")
    last = spark.createDataFrame([("c", 100), ("d", 200)], "portfolio string, last_trigger bigint")
    out = {r.portfolio: (r.milestone, r.due) for r in trades.retrain_due(counts, last).collect()}
    assert out == {"a": (0, False), "b": (100, True), "c": (200, True), "d": (200, False)}


def test_trailing_trades_without_log(spark, make_bars):
    _, df = make_bars({"a": 5})
    out = trades.trailing_trade_features(df, None).first()
    assert out.trade_count_30d is None and out.rolling_volatility is None


def test_trailing_trades_window_is_inclusive(spark):
    bars = spark.createDataFrame([("s", DAY), ("s", DAY + timedelta(days=30)), ("s", DAY + timedelta(days=31))], "symbol string, ts timestamp")
    log = spark.createDataFrame([("s", DAY, 1.0), ("s", DAY + timedelta(days=30), -3.0)], "symbol string, exit_time timestamp, pnl_usd double")
    out = trades.trailing_trade_features(bars, log).orderBy("ts").collect()
    assert [r.trade_count_30d for r in out] == [1.0, 2.0, 1.0]
    assert [r.rolling_avg_pnl for r in out] == [1.0, -1.0, -3.0]
    assert out[1].rolling_volatility == pytest.approx(np.std([1.0, -3.0], ddof=1)) and out[0].rolling_volatility == 0.0


@pytest.mark.parametrize("by_symbol", [True, False])
def test_trailing_trades_of_a_busy_day(spark, by_symbol):
    """One symbol ends most trades on one day; sums come in chunks of 50 rows and equal plain filtering."""
    from barflow.config import Layout

    rng = np.random.default_rng(2)
    when = [DAY + timedelta(days=40, microseconds=int(x)) for x in rng.integers(0, 5000, 1500)]
    when += [DAY + timedelta(days=float(x)) for x in rng.integers(0, 150, 200)]
    log = pd.DataFrame({"symbol": ["hot"] * 1500 + rng.choice(["hot", "b"], 200).tolist(), "exit_time": when, "pnl_usd": rng.normal(3, 50, 1700).round(3)})
    log.loc[1600:1650, "pnl_usd"] = 7.25
    log.loc[1699, "pnl_usd"] = None
    bars = pd.DataFrame([(s, DAY + timedelta(days=i)) for s in ("hot", "b", "c") for i in range(0, 170)] + [("hot", DAY + timedelta(days=40, microseconds=2500))], columns=["symbol", "ts"])
    out = trades.trailing_trade_features(spark.createDataFrame(bars), spark.createDataFrame(log), by_symbol=by_symbol, layout=Layout(chunk_rows=50, fanout=4))
    got = {(r.symbol, r.ts): r for r in out.collect()}
    assert len(got) == len(bars)
    for symbol, ts in bars.itertuples(index=False):
        own = log[(log.exit_time >= ts - timedelta(days=30)) & (log.exit_time <= ts) & ((log.symbol == symbol) | (not by_symbol))].pnl_usd.dropna()
        r = got[symbol, ts.to_pydatetime()]
        assert r.trade_count_30d == len(own)
        assert r.rolling_win_rate == pytest.approx((own > 0).mean() if len(own) else 0.0)
        assert r.rolling_avg_pnl == pytest.approx(own.mean() if len(own) else 0.0, abs=1e-9)
        assert r.rolling_volatility == pytest.approx(own.std() if len(own) > 1 else 0.0, rel=1e-8, abs=1e-9)


def test_partial_closes_against_a_queue(spark):
    """First opened, first closed; what is asked beyond the open size is lost. Sizes are multiples of 1/4, so all is exact."""
    from barflow.config import Layout
    from barflow.operators import closes

    rng = np.random.default_rng(4)
    lots, fills, events = [], [], []
    for portfolio, symbol, n in (("p", "hot", 400), ("p", "x", 30), ("q", "x", 5)):
        for i in range(n):
            ts = DAY + timedelta(days=int(rng.integers(0, 25)))
            size = float(rng.integers(0, 12)) / 4
            if rng.random() < 0.55:
                lots.append((portfolio, symbol, f"{symbol}{i:04}", ts, float(rng.integers(50, 150)), "SELL" if i % 3 == 0 else "BUY", size))
                events.append((portfolio, symbol, ts, 1, f"{symbol}{i:04}", size))
            else:
                fills.append((portfolio, symbol, f"f{i:04}", ts, float(rng.integers(50, 150)), "EXIT", size))
                events.append((portfolio, symbol, ts, 0, f"f{i:04}", size))
    want, queues = [], {}
    for portfolio, symbol, _, kind, name, size in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        queue = queues.setdefault((portfolio, symbol), [])
        if kind:
            queue.append([name, size])
            continue
        while size > 0 and queue:
            part = min(size, queue[0][1])
            queue[0][1] -= part
            size -= part
            if part:
                want.append((portfolio, symbol, queue[0][0], name, part, queue[0][1]))
            if not queue[0][1]:
                queue.pop(0)
    lot_df = spark.createDataFrame(lots, "portfolio string, symbol string, position_id string, entry_time timestamp, entry_price double, side string, size double")
    fill_df = spark.createDataFrame(fills, "portfolio string, symbol string, fill_id string, ts timestamp, price double, reason string, size double")
    for rows in (7, 100_000):
        out = closes.partial_closes(lot_df, fill_df, layout=Layout(chunk_rows=rows, fanout=4)).cache()
        assert sorted((r.portfolio, r.symbol, r.position_id, r.fill_id, r.size, r.remaining_size) for r in out.collect()) == sorted(want)
        left = {r.position_id: r.remaining_size for r in closes.open_lots(lot_df, out).where("portfolio = 'p'").collect()}
        assert left == {n: s for (p, _), q in queues.items() for n, s in q if p == "p" and s > 0}
    signed = closes.partial_closes(lot_df, fill_df, signed=True).collect()
    assert all(r.pnl_usd == (r.exit_price - r.entry_price) * r.size * (-1 if r.side == "SELL" else 1) for r in signed)
    named = closes.partial_closes(lot_df, fill_df.withColumn("position_id", F.lit("hot0000")), keys=("portfolio", "position_id"))
    assert {r.position_id for r in named.collect()} <= {"hot0000"}
    assert closes.partial_closes(lot_df.limit(0), fill_df).count() == closes.partial_closes(lot_df, fill_df.limit(0)).count() == 0


def test_sample_guard(spark):
    with pytest.raises(ValueError):
        trades.require_samples(spark.range(119))
    assert trades.require_samples(spark.range(120)) == 120


def test_state_document(spark, tmp_path):
    from barflow.sources import snapshots

    document = {
        "starting_cash_usd": 5000.0,
        "positions": [{"symbol": "BTC", "side": "BUY", "entry_price": 100.0, "size": 2.0, "tp_price": 110.0, "sl_price": 90.0, "entry_time": "2024-01-01T00:00:00+00:00", "position_id": "x", "surprise": 1}],
        "unknown": True,
    }
    (tmp_path / "portfolio.json").write_text(json.dumps(document, indent=2))
    accounts, positions = snapshots.read_state(spark, str(tmp_path / "portfolio.json"))
    account, position = accounts.first(), positions.first()
    assert account.cash_usd == 5000.0 and account.open_positions == 1
    assert position.remaining_size == 2.0 and position.bars_held == 0 and "surprise" not in positions.columns


def test_partial_closes_shuffle_rows_once(spark):
    """Keys that fit a task go there once; nothing else of their rows is written."""
    from barflow.operators import closes

    lots = spark.createDataFrame([("p", f"s{i % 7}", f"l{i:03}", DAY + timedelta(days=i), 10.0, "BUY", 2.0) for i in range(50)], "portfolio string, symbol string, position_id string, entry_time timestamp, entry_price double, side string, size double")
    fills = spark.createDataFrame([("p", f"s{i % 7}", f"f{i:03}", DAY + timedelta(days=i + 9), 11.0, "EXIT", 1.5) for i in range(50)], "portfolio string, symbol string, fill_id string, ts timestamp, price double, reason string, size double")
    out = closes.partial_closes(lots, fills)
    assert out.count() > 50
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_partial_ledger_writes_flows_once(spark, tmp_path):
    """Flows are dealt, compressed and summed; what is left of a lot comes with them, not by a join of identifiers."""
    from barflow.operators import closes, portfolio

    lots = spark.createDataFrame([("p", f"s{i % 7}", f"l{i:03}", DAY + timedelta(days=i), 10.0, "BUY", 2.0) for i in range(50)], "portfolio string, symbol string, position_id string, entry_time timestamp, entry_price double, side string, size double")
    fills = spark.createDataFrame([("p", f"s{i % 7}", f"f{i:03}", DAY + timedelta(days=i + 9), 11.0, "EXIT", 1.5) for i in range(50)], "portfolio string, symbol string, fill_id string, ts timestamp, price double, reason string, size double")
    done = closes.partial_closes(lots, fills)
    ledger = portfolio.cash_ledger(lots, closes=done)
    left = {(r.position_id, r.fill_id): r.remaining_size for r in done.collect()}
    assert {(r.position_id, r.fill_id): r.remaining_size for r in ledger.where("fill_id <> ''").collect()} == left
    assert "Scan parquet" in ledger._jdf.queryExecution().executedPlan().toString()
