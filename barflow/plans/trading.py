"""Queries: signals, sizing, gates, positions, ledger, trades, reconcile."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.config import LIVE
from barflow.functions import microstructure, risk, signals, sizing
from barflow.operators import barriers, closes, exits, features, portfolio, reconcile, trades
from barflow.operators.series import apply_local, join_per_key
from barflow.plans.registry import query, r, us
from barflow.plans.sqlparts import BARS, FEATURES, live_labels, with_
from barflow.session import cut_lineage
from barflow.sources import sinks, tables

# ------------------------------------------------------------------ scored rows and signals
SCORED = """
meta AS (SELECT symbol, count(*) FILTER (label <> 0 OR symbol LIKE '%F') AS trained_rows FROM lab GROUP BY 1),
scored AS (SELECT lab.symbol, ts, bar_idx, n_bars, close, atr, norm_rsi AS p_tp, 0.5 * (1 - norm_rsi) AS p_sl, label, log_return,
             trained_rows FROM lab JOIN meta USING (symbol) WHERE norm_rsi IS NOT NULL),
raw AS (SELECT *, greatest(1.5 * atr, 250) AS tpd, atr AS sld, trained_rows < 1000 AS cold,
             p_tp * greatest(1.5 * atr, 250) - p_sl * atr - 2 * (close * 0.001 + close * 2 / 10000) AS e FROM scored),
sig AS (SELECT symbol, ts, bar_idx, n_bars, CASE WHEN NOT cold AND e > 0 AND p_tp > 0.55 THEN 'BUY' ELSE 'SIT_OUT' END AS signal,
             CASE WHEN cold THEN 'WARMUP' END AS reason, close AS price, CASE WHEN cold THEN 0 ELSE p_tp END AS p_tp,
             CASE WHEN cold THEN 0 ELSE p_sl END AS p_sl, CASE WHEN cold THEN 1 ELSE greatest(0, 1 - p_tp - p_sl) END AS p_time,
             CASE WHEN cold THEN 0 ELSE e END AS edge, close + tpd AS tp_price, close - sld AS sl_price FROM raw)"""
SIGNALS = FEATURES + "," + live_labels(expiry="0") + "," + SCORED


def scored_rows(spark, sf_dir):
    """Rows scored by a rule (RSI as the chance of a take-profit) with per-symbol model metadata.

    The metadata counts all labelled rows of some symbols and only touched ones of the others,
    so that warm and cold models both occur.
    """
    frame = apply_local(
        tables.indexed_daily(spark, sf_dir), features.feature_op(), barriers.live_barrier(expiry="zero")
    )
    counted = (F.col("label") != 0) | F.col("symbol").endswith("F")
    meta = frame.groupBy("symbol").agg(F.count_if(counted).alias("trained_rows"))
    rows = frame.where(F.col("norm_rsi").isNotNull()).withColumns(
        {"p_tp": F.col("norm_rsi"), "p_sl": 0.5 * (1.0 - F.col("norm_rsi"))}
    )
    return join_per_key(rows, meta, ["symbol"])


def signal_rows(spark, sf_dir):
    scored = scored_rows(spark, sf_dir)
    columns = signals.signal_columns(*[F.col(c) for c in ("close", "atr", "p_tp", "p_sl", "trained_rows")])
    return scored.select("symbol", "ts", "bar_idx", *[c.alias(n) for n, c in columns.items()])


@query(
    "e1_signal_decision",
    with_(SIGNALS, select="""SELECT symbol, epoch_us(ts) AS ts_us, signal, reason, price, round(p_tp, 6) AS p_tp, round(p_sl, 6) AS p_sl,
        round(p_time, 6) AS p_time, round(edge, 3) AS edge, round(tp_price, 3) AS tp_price, round(sl_price, 3) AS sl_price FROM sig"""),
)
def signal_decision(spark, sf_dir):
    out = signals.score_signals(scored_rows(spark, sf_dir))
    return out.select(
        "symbol", us(), "signal", "reason", "price", r("p_tp"), r("p_sl"), r("p_time"), r("edge", 3), r("tp_price", 3), r("sl_price", 3)
    )


@query(
    "e2_entry_size",
    with_(BARS, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx,
        round(CASE WHEN close - 20000 > 0 THEN 0.1 * (10000 + volume) / (close - 20000) ELSE 0 END, 6) AS size FROM ib"""),
)
def entry_size(spark, sf_dir):
    size = signals.entry_size(F.lit(10_000.0) + F.col("volume"), F.col("close") - 20_000.0)
    return tables.indexed_daily(spark, sf_dir).select("symbol", "bar_idx", F.round(size, 6).alias("size"))


KELLY = """
kin AS (SELECT symbol, ts, close - 5000 AS price, volume * 10 - 100 AS equity, (close - low) / nullif(high - low, 0) AS win_prob,
          (high - open) / nullif(open - low, 0) AS win_loss FROM bars),
kf AS (SELECT *, CASE WHEN win_prob > 0 AND win_prob < 1 AND win_loss > 0
          THEN least(greatest(0.25 * (win_prob - (1 - win_prob) / win_loss), 0), 0.05) END AS kelly_f FROM kin),
ku AS (SELECT *, CASE WHEN kelly_f IS NULL THEN NULL WHEN equity > 0 AND price > 0 AND least(kelly_f * equity, 0.05 * equity, equity) >= 5
          THEN least(kelly_f * equity, 0.05 * equity, equity) / price ELSE 0 END AS size_units FROM kf)"""


def kelly_input(spark, sf_dir):
    """Close and open within the bar's range stand for a win chance and a payoff ratio."""
    def share(a, b):
        return F.try_divide(a, F.nullif(b, F.lit(0.0)))

    return tables.daily_bars(spark, sf_dir).select(
        "symbol",
        "ts",
        (F.col("close") - 5000.0).alias("price"),
        (F.col("volume") * 10.0 - 100.0).alias("equity"),
        share(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("win_prob"),
        share(F.col("high") - F.col("open"), F.col("open") - F.col("low")).alias("win_loss"),
    )


@query("e3_fractional_kelly", with_(BARS, KELLY, select="SELECT symbol, epoch_us(ts) AS ts_us, round(kelly_f, 8) AS kelly_f FROM kf"))
def fractional_kelly(spark, sf_dir):
    share = sizing.fractional_kelly(F.col("win_prob"), F.col("win_loss"))
    return kelly_input(spark, sf_dir).select("symbol", us(), F.round(share, 8).alias("kelly_f"))


@query("e4_kelly_units", with_(BARS, KELLY, select="SELECT symbol, epoch_us(ts) AS ts_us, round(size_units, 8) AS size_units FROM ku"))
def kelly_units(spark, sf_dir):
    share = sizing.fractional_kelly(F.col("win_prob"), F.col("win_loss"))
    units = sizing.kelly_units(share, F.col("equity"), F.col("price"))
    return kelly_input(spark, sf_dir).select("symbol", us(), F.round(units, 8).alias("size_units"))


@query(
    "e5_size_positions",
    with_(BARS, KELLY, select="""SELECT symbol, epoch_us(ts) AS ts_us, round(kelly_f, 8) AS kelly_f, round(size_units, 8) AS size_units,
        round(size_units * price, 6) AS notional, size_units * price >= 5 AS meets_min FROM ku"""),
)
def size_positions(spark, sf_dir):
    out = sizing.size_positions(kelly_input(spark, sf_dir))
    return out.select("symbol", us(), r("kelly_f", 8), r("size_units", 8), r("notional"), "meets_min")


GATES = """
gin AS (SELECT symbol, ts, 10000 + volume - 400 AS equity, CASE WHEN volume > 40 THEN 10000e0 ELSE 0e0 END AS start_equity,
          high / 20 AS existing, close AS price, volume / 100000 AS size FROM bars),
g AS (SELECT *, (start_equity - equity) / nullif(start_equity, 0) AS dd, (existing + abs(price * size)) / nullif(equity, 0) AS ex, abs(price * size) AS nt FROM gin),
h AS (SELECT *, start_equity > 0 AND dd >= 0.03 AS b1, nt < 5 AS b2, equity <= 0 OR ex > 0.5 AS b3 FROM g),
texts AS (SELECT *, CASE WHEN start_equity <= 0 THEN 'start_equity_zero' WHEN b1 THEN 'daily_drawdown ' || printf('%.2f%%', dd * 100) || ' >= limit 3.00%' ELSE 'ok' END AS t1,
          CASE WHEN b2 THEN 'notional ' || printf('%.2f', nt) || ' < minimum 5.00' ELSE 'ok' END AS t2,
          CASE WHEN equity <= 0 THEN 'equity_zero' WHEN b3 THEN 'exposure ' || printf('%.2f%%', ex * 100) || ' > limit 50.00%' ELSE 'ok' END AS t3 FROM h)"""


def gate_input(spark, sf_dir):
    """Accounts derived from bars so that every gate passes and blocks somewhere."""
    return tables.daily_bars(spark, sf_dir).select(
        "symbol",
        "ts",
        (10_000.0 + F.col("volume") - 400.0).alias("equity"),
        F.when(F.col("volume") > 40, F.lit(10_000.0)).otherwise(F.lit(0.0)).alias("start_equity"),
        (F.col("high") / 20).alias("existing"),
        F.col("close").alias("price"),
        (F.col("volume") / 100_000).alias("size"),
    )


def _gate_query(spark, sf_dir, gate):
    return gate_input(spark, sf_dir).select("symbol", us(), gate.alias("g")).select("symbol", "ts_us", "g.ok", "g.reason")


@query("e6_drawdown_gate", with_(BARS, GATES, select="SELECT symbol, epoch_us(ts) AS ts_us, NOT b1 AS ok, t1 AS reason FROM texts"))
def drawdown_gate(spark, sf_dir):
    return _gate_query(spark, sf_dir, risk.drawdown_gate(F.col("equity"), F.col("start_equity")))


@query("e7_exposure_gate", with_(BARS, GATES, select="SELECT symbol, epoch_us(ts) AS ts_us, NOT b3 AS ok, t3 AS reason FROM texts"))
def exposure_gate(spark, sf_dir):
    new = F.abs(F.col("price") * F.col("size"))
    return _gate_query(spark, sf_dir, risk.exposure_gate(F.col("existing"), new, F.col("equity")))


@query("e8_notional_gate", with_(BARS, GATES, select="SELECT symbol, epoch_us(ts) AS ts_us, NOT b2 AS ok, t2 AS reason FROM texts"))
def notional_gate(spark, sf_dir):
    return _gate_query(spark, sf_dir, risk.notional_gate(F.col("price"), F.col("size")))


@query(
    "e9_risk_gate",
    with_(BARS, GATES, select="""SELECT symbol, epoch_us(ts) AS ts_us, NOT (b1 OR b2 OR b3) AS ok,
        CASE WHEN NOT (b1 OR b2 OR b3) THEN 'ok' ELSE concat_ws('; ', CASE WHEN b1 THEN t1 END, CASE WHEN b2 THEN t2 END, CASE WHEN b3 THEN t3 END) END AS reasons FROM texts"""),
)
def risk_gate(spark, sf_dir):
    gate = risk.risk_gate(*[F.col(c) for c in ("equity", "start_equity", "existing", "price", "size")])
    out = gate_input(spark, sf_dir).select("symbol", us(), gate.alias("g"))
    return out.select("symbol", "ts_us", "g.ok", F.array_join("g.reasons", "; ").alias("reasons"))


@query(
    "e10_book_imbalance",
    """WITH v AS (SELECT vec_id AS snapshot_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings),
       s AS (SELECT snapshot_id, list_sum(e[1:5]) AS b5, list_sum(e[33:37]) AS a5, list_sum(e[1:32]) AS b, list_sum(e[33:64]) AS a FROM v)
       SELECT snapshot_id, round((b5 - a5) / (b5 + a5), 6) AS obi_5, round((b - a) / (b + a), 6) AS obi_all FROM s""",
)
def book_imbalance(spark, sf_dir):
    book = tables.order_book(spark, sf_dir)
    top = microstructure.book_imbalance(F.col("bids"), F.col("asks"), 5)
    full = microstructure.book_imbalance(F.col("bids"), F.col("asks"))
    return book.select("snapshot_id", F.round(top, 6).alias("obi_5"), F.round(full, 6).alias("obi_all"))


@query(
    "a7_flow_imbalance",
    """WITH f AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS ts,
         sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN value ELSE 0 END) AS buy, sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 0 ELSE value END) AS sell
         FROM events GROUP BY 1)
       SELECT epoch_us(ts) AS ts_us, round(buy, 2) AS buy, round(sell, 2) AS sell,
         CASE WHEN buy + sell = 0 THEN 0 ELSE round((buy - sell) / (buy + sell), 6) END AS imbalance FROM f""",
)
def flow_imbalance(spark, sf_dir):
    out = microstructure.flow_imbalance(tables.trade_flow(spark, sf_dir), "1 hour")
    return out.select(us(), r("buy", 2), r("sell", 2), r("imbalance"))


META = """
md AS (SELECT symbol, bar_idx, label, CASE WHEN norm_rsi > 0.5 THEN 1 ELSE -1 END AS pred, norm_rsi AS pu, 1 - norm_rsi AS pd,
         (close - low) / nullif(high - low, 0) AS m FROM lab WHERE norm_rsi IS NOT NULL AND label IS NOT NULL)"""


def meta_input(spark, sf_dir):
    frame = apply_local(
        tables.indexed_daily(spark, sf_dir), features.feature_op(), barriers.live_barrier(expiry="zero")
    )
    known = F.col("norm_rsi").isNotNull() & F.col("label").isNotNull()
    chance = F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return frame.where(known).select(
        "symbol",
        "bar_idx",
        "label",
        F.when(F.col("norm_rsi") > 0.5, 1).otherwise(-1).alias("pred"),
        F.col("norm_rsi").alias("pu"),
        (1.0 - F.col("norm_rsi")).alias("pd"),
        chance.alias("m"),
    )


META_SQL = FEATURES + "," + live_labels(expiry="0") + "," + META


@query(
    "e13_meta_label",
    with_(META_SQL, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(label <> 0 AND pred = label AS INTEGER) AS meta FROM md"),
)
def meta_label(spark, sf_dir):
    target = signals.meta_label(F.col("pred"), F.col("label"))
    return meta_input(spark, sf_dir).select("symbol", "bar_idx", target.alias("meta"))


@query(
    "e14_meta_gating",
    with_(META_SQL, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(up, 6) AS p_up,
        CAST(CASE WHEN up >= 0.6 THEN 1 WHEN 1 - up >= 0.6 THEN -1 ELSE 0 END AS INTEGER) AS bet
        FROM (SELECT *, CASE WHEN pred = 1 THEN m ELSE 1 - m END AS up FROM md)"""),
)
def meta_gating(spark, sf_dir):
    down, up = signals.side_probabilities(F.col("pred"), F.col("m"))
    bet = signals.gated_bet(down, up, 0.6)
    return meta_input(spark, sf_dir).select("symbol", "bar_idx", F.round(up, 6).alias("p_up"), bet.alias("bet"))


@query(
    "e15_direction_pick",
    with_(META_SQL, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx,
        CAST(CASE WHEN pu >= 0.5 THEN 1 WHEN pd >= 0.5 THEN -1 ELSE 0 END AS INTEGER) AS direction,
        CAST(CASE WHEN pu >= 0.55 THEN 1 WHEN pd >= 0.55 THEN -1 ELSE 0 END AS INTEGER) AS strict_direction FROM md"""),
)
def direction_pick(spark, sf_dir):
    classes = [(-1, F.col("pd")), (1, F.col("pu"))]
    return meta_input(spark, sf_dir).select(
        "symbol", "bar_idx", signals.pick_direction(classes).alias("direction"),
        signals.pick_direction(classes, 0.55).alias("strict_direction"),
    )


@query("f6_active_labels", with_(META_SQL, select="SELECT symbol, label, count(*) AS n FROM md WHERE label <> 0 GROUP BY 1, 2"))
def active_labels(spark, sf_dir):
    return meta_input(spark, sf_dir).where(F.col("label") != 0).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ positions and exits
POSITIONS = """
pos AS (SELECT symbol, symbol || '_' || bar_idx AS position_id, 'pf_' || substr(symbol, 1, 1) AS portfolio, bar_idx AS entry_idx, ts AS entry_time, n_bars,
          price AS entry_price, 0.1 * 1000 / price AS size, tp_price, sl_price FROM sig WHERE signal = 'BUY'),
hits AS (SELECT p.position_id, min(b.bar_idx) AS exit_idx FROM pos p JOIN ib b ON b.symbol = p.symbol AND b.bar_idx > p.entry_idx
          AND (b.low <= p.sl_price OR b.high >= p.tp_price) GROUP BY 1),
px AS (SELECT p.*, h.exit_idx, b.ts AS exit_time, CASE WHEN b.low <= sl_price THEN sl_price WHEN b.high >= tp_price THEN tp_price END AS exit_price,
          CASE WHEN b.low <= sl_price THEN 'STOP_LOSS' WHEN b.high >= tp_price THEN 'TAKE_PROFIT' END AS exit_reason,
          CASE WHEN h.exit_idx IS NULL THEN p.n_bars - 1 - entry_idx ELSE h.exit_idx - entry_idx - 1 END AS bars_held
        FROM pos p LEFT JOIN hits h USING (position_id) LEFT JOIN ib b ON b.symbol = p.symbol AND b.bar_idx = h.exit_idx),
tr_log AS (SELECT *, (exit_price - entry_price) * size AS pnl_usd, (exit_price / entry_price - 1) * 100 AS return_pct FROM px WHERE exit_price IS NOT NULL)"""
POSITION_SQL = SIGNALS + "," + POSITIONS


def all_positions(spark, sf_dir, assume_warm=False):
    """Every BUY signal as a position, with its exit. Written once: most plans read it twice."""
    indexed = cut_lineage(tables.indexed_daily(spark, sf_dir))
    frame = apply_local(indexed, features.feature_op(), barriers.live_barrier(expiry="zero"))
    counted = (F.col("label") != 0) | F.col("symbol").endswith("F")
    meta = frame.groupBy("symbol").agg(F.count_if(counted).alias("trained_rows"))
    if assume_warm:
        meta = meta.withColumn("trained_rows", F.greatest("trained_rows", F.lit(LIVE.min_warmup_rows)))
    rows = join_per_key(frame.where(F.col("norm_rsi").isNotNull()), meta, ["symbol"])
    columns = signals.signal_columns(
        F.col("close"), F.col("atr"), F.col("norm_rsi"), 0.5 * (1.0 - F.col("norm_rsi")), F.col("trained_rows")
    )
    decided = rows.select("symbol", "ts", "bar_idx", *[c.alias(n) for n, c in columns.items()])
    positions = portfolio.open_from_signals(decided, F.lit(1000.0)).withColumn(
        "portfolio", F.concat(F.lit("pf_"), F.substring("symbol", 1, 1))
    )
    return cut_lineage(exits.exit_join(positions, indexed)), indexed


@query(
    "j9_position_exits",
    with_(POSITION_SQL, select="""SELECT position_id, epoch_us(exit_time) AS exit_time_us, round(exit_price, 3) AS exit_price, exit_reason FROM px"""),
)
def position_exits(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    return out.select("position_id", us("exit_time"), r("exit_price", 3), "exit_reason")


@query("w21_bars_held", with_(POSITION_SQL, select="SELECT position_id, CAST(bars_held AS BIGINT) AS bars_held FROM px"))
def bars_held(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    return out.select("position_id", "bars_held")


@query(
    "a17_closed_trades",
    with_(POSITION_SQL, select="SELECT position_id, round(pnl_usd, 6) AS pnl_usd, round(return_pct, 6) AS return_pct FROM tr_log"),
)
def closed_trades(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    return portfolio.closed_trades(out).select("position_id", r("pnl_usd"), r("return_pct"))


@query(
    "a17_closed_trades_signed",
    with_(POSITION_SQL, select="""SELECT portfolio, round(sum(CASE WHEN symbol LIKE 'A%' THEN -1 ELSE 1 END * pnl_usd), 4) AS pnl_usd,
        round(avg(CASE WHEN symbol LIKE 'A%' THEN -1 ELSE 1 END * return_pct), 6) AS return_pct FROM tr_log GROUP BY 1"""),
)
def closed_trades_signed(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    sided = out.withColumn("side", F.when(F.col("symbol").startswith("A"), F.lit("SELL")).otherwise(F.lit("BUY")))
    done = portfolio.closed_trades(sided, signed=True)
    return done.groupBy("portfolio").agg(
        F.round(F.sum("pnl_usd"), 4).alias("pnl_usd"), F.round(F.avg("return_pct"), 6).alias("return_pct")
    )


FLOWS = """
flows AS (SELECT portfolio, entry_time AS ts, 1 AS seq, position_id, -entry_price * size AS flow, entry_price * size AS ex FROM pos
          UNION ALL SELECT portfolio, exit_time, 0, position_id, exit_price * size, -entry_price * size FROM tr_log)"""


@query(
    "w20_cash_ledger",
    with_(POSITION_SQL, FLOWS,
        select="""SELECT portfolio, position_id, CAST(seq AS INTEGER) AS seq, epoch_us(ts) AS ts_us,
        round(10000 + sum(flow) OVER w, 4) AS cash_usd, round(sum(ex) OVER w, 4) AS exposure FROM flows
        WINDOW w AS (PARTITION BY portfolio ORDER BY ts, seq, position_id ROWS UNBOUNDED PRECEDING)"""),
)
def cash_ledger(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    ledger = portfolio.cash_ledger(out)
    # A flat book is 0 up to rounding of the sum; adding 0.0 removes the sign of zero.
    exposure = (F.round("exposure", 4) + F.lit(0.0)).alias("exposure")
    return ledger.select("portfolio", "position_id", "seq", us(), r("cash_usd", 4), exposure)


PARTIAL = """
lines AS (SELECT l_linestatus AS portfolio, 's' || l_suppkey AS symbol, l_returnflag, l_linenumber, l_quantity, CAST(l_shipdate AS TIMESTAMP) AS ts, floor(l_extendedprice / l_quantity) AS price,
   concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id FROM lineitem),
pev AS (SELECT portfolio, symbol, ts, id, 1 AS seq, l_quantity AS o, 0e0 AS c, price FROM lines WHERE l_returnflag <> 'R'
   UNION ALL SELECT portfolio, symbol, ts, id, 0, 0e0, l_quantity * 1.5, price + l_linenumber * 7 - 20 FROM lines WHERE l_returnflag = 'R'),
psum AS (SELECT *, sum(o) OVER w AS a, sum(c) OVER w AS f FROM pev WINDOW w AS (PARTITION BY portfolio, symbol ORDER BY ts, seq, id ROWS UNBOUNDED PRECEDING)),
plost AS (SELECT *, greatest(0, coalesce(max(CASE WHEN seq = 0 THEN f - a END) OVER w, 0)) AS now,
   greatest(0, coalesce(max(CASE WHEN seq = 0 THEN f - a END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS old
   FROM psum WINDOW w AS (PARTITION BY portfolio, symbol ORDER BY ts, seq, id)),
pclose AS (SELECT l.portfolio, l.symbol, l.id AS position_id, x.id AS fill_id, l.ts AS entry_time, x.ts AS exit_time, l.price AS entry_price, x.price AS exit_price,
   least(l.a, x.f - x.now) - greatest(l.a - l.o, x.f - x.c - x.old) AS size, l.a - least(l.a, x.f - x.now) AS remaining_size
   FROM plost l JOIN plost x ON l.portfolio = x.portfolio AND l.symbol = x.symbol AND l.seq = 1 AND x.seq = 0
    AND l.a - l.o < x.f - x.now AND x.f - x.c - x.old < l.a)"""


@query(
    "a17_partial_closes",
    with_(PARTIAL, select="""SELECT portfolio, symbol, position_id, fill_id, size, remaining_size, round((exit_price - entry_price) * size, 4) AS pnl_usd,
        round((exit_price / entry_price - 1) * 100, 6) AS return_pct FROM pclose"""),
)
def partial_closes(spark, sf_dir):
    """Closing fills against the lots of their symbol, first opened first."""
    out = closes.partial_closes(*tables.lots_and_fills(spark, sf_dir))
    return out.select("portfolio", "symbol", "position_id", "fill_id", "size", "remaining_size", r("pnl_usd", 4), r("return_pct"))


@query(
    "w20_partial_ledger",
    with_(PARTIAL, """pflow AS (SELECT portfolio, ts, 1 AS seq, id AS position_id, '' AS fill_id, -price * o AS flow, price * o AS ex, CAST(NULL AS DOUBLE) AS remaining FROM pev WHERE seq = 1
          UNION ALL SELECT portfolio, exit_time, 0, position_id, fill_id, exit_price * size, -entry_price * size, remaining_size FROM pclose)""",
        select="""SELECT portfolio, position_id, fill_id, epoch_us(ts) AS ts_us, 10000 + sum(flow) OVER w AS cash_usd, sum(ex) OVER w AS exposure, remaining FROM pflow
        WINDOW w AS (PARTITION BY portfolio ORDER BY ts, seq, position_id, fill_id ROWS UNBOUNDED PRECEDING)"""),
)
def partial_ledger(spark, sf_dir):
    """Cash and exposure after every opening and partial close, and what is left of the lot. All amounts are exact."""
    lots, fills = tables.lots_and_fills(spark, sf_dir)
    out = portfolio.cash_ledger(lots, closes=closes.partial_closes(lots, fills)).withColumnRenamed("remaining_size", "remaining")
    return out.select("portfolio", "position_id", "fill_id", us(), "cash_usd", (F.col("exposure") + F.lit(0.0)).alias("exposure"), "remaining")


@query(
    "a16_daily_results",
    with_(POSITION_SQL, """days AS (SELECT portfolio, CAST(exit_time AS DATE) AS day, sum(pnl_usd) AS p, count(*) AS n FROM tr_log GROUP BY 1, 2)""",
        select="""SELECT portfolio, CAST(day AS VARCHAR) AS day, round(p, 5) AS daily_pnl, n AS n_trades, round(10000 + coalesce(sum(p) OVER
        (PARTITION BY portfolio ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS daily_start_equity FROM days"""),
)
def daily_results(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    days = portfolio.daily_results(portfolio.closed_trades(out))
    return days.select("portfolio", F.col("day").cast("string").alias("day"), r("daily_pnl", 5), "n_trades", r("daily_start_equity", 4))


COUNTS = """
cnt AS (SELECT portfolio, count(*) AS total_trades, count(*) FILTER (pnl_usd > 0) AS winning_trades FROM tr_log GROUP BY 1)"""


@query(
    "a1_trade_counts",
    with_(POSITION_SQL, COUNTS, select="SELECT portfolio, total_trades, winning_trades, round(winning_trades / total_trades, 6) AS win_rate FROM cnt"),
)
def trade_counts(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    return portfolio.trade_counts(portfolio.closed_trades(out)).select("portfolio", "total_trades", "winning_trades", r("win_rate"))


@query(
    "a2_retrain_due",
    with_(POSITION_SQL, COUNTS, select="""SELECT portfolio, total_trades, total_trades // 100 * 100 AS milestone,
        total_trades // 100 * 100 > CASE WHEN portfolio = 'pf_N' THEN 100000 ELSE 100 END AND total_trades >= 100 AS due FROM cnt"""),
)
def retrain_due(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    counts = portfolio.trade_counts(portfolio.closed_trades(out))
    mark = F.when(F.col("portfolio") == "pf_N", F.lit(100_000)).otherwise(F.lit(100))
    last = counts.select("portfolio", mark.cast("bigint").alias("last_trigger"))
    return trades.retrain_due(counts, last)


BOOK = """
cash AS (SELECT portfolio, 10000 + coalesce(sum(f), 0) AS cash_usd FROM (
   SELECT portfolio, -entry_price * size AS f FROM pos UNION ALL SELECT portfolio, exit_price * size FROM tr_log) GROUP BY 1),
openp AS (SELECT * FROM px WHERE exit_price IS NULL),
marks AS (SELECT symbol, arg_max(close, ts) AS mark, max(ts) AS mark_ts FROM ib WHERE symbol <> 'NO' GROUP BY 1),
mtm AS (SELECT c.portfolio, c.cash_usd, coalesce(sum(coalesce(mark, entry_price) * size), 0) AS pv, count(o.position_id) AS n
   FROM cash c LEFT JOIN openp o USING (portfolio) LEFT JOIN marks m USING (symbol) GROUP BY 1, 2)"""


def book(spark, sf_dir):
    """(open positions, prices without one symbol, cash per portfolio, closed trades)."""
    out, indexed = all_positions(spark, sf_dir)
    flows = portfolio.cash_flows(out)
    cash = flows.groupBy("portfolio").agg((F.sum("flow") + LIVE.starting_cash).alias("cash_usd"))
    prices = portfolio.latest_prices(indexed.where(F.col("symbol") != "NO"))
    return out.where(F.col("exit_price").isNull()), prices, cash, portfolio.closed_trades(out)


@query(
    "j7_mark_to_market",
    with_(POSITION_SQL, BOOK, select="""SELECT portfolio, round(cash_usd, 4) AS cash_usd, round(pv, 4) AS position_value,
        round(cash_usd + pv, 4) AS equity_usd, n AS open_positions FROM mtm"""),
)
def mark_to_market(spark, sf_dir):
    held, prices, cash, _ = book(spark, sf_dir)
    out = portfolio.mark_to_market(held, prices, cash)
    return out.select("portfolio", r("cash_usd", 4), r("position_value", 4), r("equity_usd", 4), "open_positions")


@query(
    "a6_portfolio_heat",
    with_(POSITION_SQL, BOOK, select="""SELECT m.portfolio, round(CASE WHEN cash_usd + pv > 0 THEN coalesce((SELECT sum(abs(entry_price * size))
        FROM openp o WHERE o.portfolio = m.portfolio), 0) / (cash_usd + pv) ELSE 0 END, 6) AS heat FROM mtm m"""),
)
def portfolio_heat(spark, sf_dir):
    held, prices, cash, _ = book(spark, sf_dir)
    return portfolio.portfolio_heat(held, portfolio.mark_to_market(held, prices, cash)).select("portfolio", r("heat"))


SNAPSHOT_SELECT = """
acc AS (SELECT DISTINCT portfolio, symbol FROM pos),
firsts AS (SELECT portfolio, symbol, arg_min(position_id, (entry_time, position_id)) AS position_id FROM openp GROUP BY 1, 2),
snap AS (SELECT a.portfolio, a.symbol, epoch_us(mark_ts) AS timestamp_us, round(c.cash_usd, 4) AS cash_usd,
   round(c.cash_usd + coalesce(o.size * coalesce(mark, o.entry_price), 0), 4) AS equity_usd, 10000e0 AS starting_cash_usd,
   (SELECT count(*) FROM openp z WHERE z.portfolio = a.portfolio) AS open_positions,
   CASE WHEN o.position_id IS NULL THEN '' ELSE a.symbol END AS position_symbol, CASE WHEN o.position_id IS NULL THEN '' ELSE 'BUY' END AS position_side,
   round(coalesce(o.size, 0), 6) AS position_size, coalesce(o.entry_price, 0) AS position_entry_price, round(coalesce(o.tp_price, 0), 3) AS position_tp_price,
   round(coalesce(o.sl_price, 0), 3) AS position_sl_price, CAST(coalesce(o.bars_held, 0) AS BIGINT) AS position_bars_held,
   coalesce(cnt.total_trades, 0) AS total_trades, coalesce(cnt.winning_trades, 0) AS winning_trades, round(coalesce(cnt.winning_trades / cnt.total_trades, 0), 4) AS win_rate
  FROM acc a JOIN cash c USING (portfolio) LEFT JOIN marks m ON m.symbol = a.symbol LEFT JOIN firsts f ON f.symbol = a.symbol AND f.portfolio = a.portfolio
  LEFT JOIN openp o ON o.position_id = f.position_id LEFT JOIN cnt ON cnt.portfolio = a.portfolio)"""


def snapshot_rows(spark, sf_dir):
    held, prices, cash, done = book(spark, sf_dir)
    accounts = held.select("portfolio", "symbol").unionByName(done.select("portfolio", "symbol")).distinct().join(cash, "portfolio")
    return portfolio.snapshots(accounts, held, prices, done)


def _rounded_snapshot(df):
    return df.select(
        "portfolio", us("timestamp"), r("cash_usd", 4), r("equity_usd", 4), "starting_cash_usd", "open_positions", "position_symbol",
        "position_side", r("position_size"), "position_entry_price", r("position_tp_price", 3), r("position_sl_price", 3),
        F.col("position_bars_held").cast("bigint").alias("position_bars_held"), "total_trades", "winning_trades", "win_rate",
    )


@query("a19_portfolio_snapshot", with_(POSITION_SQL, BOOK, COUNTS, SNAPSHOT_SELECT, select="SELECT * EXCLUDE (symbol) FROM snap"))
def portfolio_snapshot(spark, sf_dir):
    return _rounded_snapshot(snapshot_rows(spark, sf_dir))


@query(
    "s9_live_row",
    with_(POSITION_SQL, FLOWS, select="""SELECT portfolio, position_id, CAST(seq AS INTEGER) AS seq, epoch_us(ts) AS ts_us, round(cash, 4) AS cash_usd FROM (
        SELECT *, 10000 + sum(flow) OVER (PARTITION BY portfolio) AS cash,
          row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC, seq DESC, position_id DESC) AS rn FROM flows) WHERE rn = 1"""),
)
def live_row(spark, sf_dir):
    out, _ = all_positions(spark, sf_dir)
    last = sinks.live_rows(portfolio.cash_ledger(out), order=("ts", "seq", "position_id"))
    return last.select("portfolio", "position_id", "seq", us(), r("cash_usd", 4))


@query(
    "s11_telemetry",
    with_(POSITION_SQL, select="""SELECT epoch_us(ts) AS timestamp_us, 'signal' AS type, symbol, round(price, 6) AS price, round(p_tp, 4) AS p_tp,
        round(p_sl, 4) AS p_sl, round(round(edge, 6) + 3e-7, 3) AS edge, round(round(tp_price, 6) + 3e-7, 3) AS tp_price, round(round(sl_price, 6) + 3e-7, 3) AS sl_price, signal, CAST(NULL AS DOUBLE) AS pnl FROM sig
        UNION ALL SELECT epoch_us(exit_time), 'trade', symbol, round(entry_price, 6), NULL, NULL, NULL, NULL, NULL, 'BUY', round(pnl_usd, 6) FROM tr_log"""),
)
def telemetry(spark, sf_dir):
    positions, _ = all_positions(spark, sf_dir)
    out = sinks.telemetry_rows(signal_rows(spark, sf_dir), portfolio.closed_trades(positions))
    return out.select(
        us("timestamp"), "type", "symbol", "price", "p_tp", "p_sl", *[F.round(F.col(c) + 3e-7, 3).alias(c) for c in ("edge", "tp_price", "sl_price")],
        "signal", r("pnl"),
    )


@query(
    "w14_trailing_trades",
    with_(POSITION_SQL, """tf AS (SELECT b.symbol, b.bar_idx, count(t.position_id) AS n, count(*) FILTER (t.pnl_usd > 0) AS w, avg(t.pnl_usd) AS m, stddev_samp(t.pnl_usd) AS s
          FROM ib b LEFT JOIN tr_log t ON t.symbol = b.symbol AND t.exit_time BETWEEN b.ts - INTERVAL 30 DAY AND b.ts GROUP BY 1, 2)""",
        select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(n AS DOUBLE) AS trade_count_30d, CASE WHEN n = 0 THEN 0 ELSE round(w / n, 6) END AS rolling_win_rate,
        round(coalesce(m, 0), 5) AS rolling_avg_pnl, CASE WHEN n > 1 THEN round(s, 5) ELSE 0 END AS rolling_volatility FROM tf"""),
)
def trailing_trades(spark, sf_dir):
    positions, indexed = all_positions(spark, sf_dir)
    out = trades.trailing_trade_features(indexed, portfolio.closed_trades(positions))
    return out.select(
        "symbol", "bar_idx", "trade_count_30d", r("rolling_win_rate"), r("rolling_avg_pnl", 5), r("rolling_volatility", 5)
    )


@query(
    "j8_trailing_trades_global",
    with_(POSITION_SQL, """tf AS (SELECT b.symbol, b.bar_idx, count(t.position_id) AS n, avg(t.pnl_usd) AS m
          FROM ib b LEFT JOIN tr_log t ON t.exit_time BETWEEN b.ts - INTERVAL 30 DAY AND b.ts GROUP BY 1, 2)""",
        select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(n AS DOUBLE) AS trade_count_30d, round(coalesce(m, 0), 5) AS rolling_avg_pnl FROM tf"""),
)
def trailing_trades_global(spark, sf_dir):
    positions, indexed = all_positions(spark, sf_dir)
    out = trades.trailing_trade_features(indexed, portfolio.closed_trades(positions), by_symbol=False)
    return out.select("symbol", "bar_idx", "trade_count_30d", r("rolling_avg_pnl", 5))


@query(
    "f7_parse_exit_times",
    """SELECT portfolio, count(*) AS n FROM (SELECT o_orderstatus AS portfolio, try_cast(CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown'
       ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS t FROM orders) WHERE t IS NOT NULL GROUP BY 1""",
)
def parse_exit_times(spark, sf_dir):
    text = F.when(F.col("o_orderpriority").startswith("1"), F.lit("unknown")).otherwise(
        F.date_format(tables.utc("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")
    )
    log = tables.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("portfolio"), text.alias("exit_time"))
    return trades.parse_exit_times(log).groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f8_buy_admission",
    with_(POSITION_SQL, select="""SELECT symbol, count(*) AS n FROM sig WHERE signal = 'BUY' AND symbol NOT IN
        (SELECT symbol FROM px WHERE exit_price IS NULL) GROUP BY 1"""),
)
def buy_admission(spark, sf_dir):
    positions, _ = all_positions(spark, sf_dir)
    free = portfolio.admit(signal_rows(spark, sf_dir), positions.where(F.col("exit_price").isNull()))
    return free.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f9_cash_admission",
    with_(POSITION_SQL, BOOK, select="""SELECT c.portfolio, count(*) AS n FROM pos p JOIN cash c ON c.portfolio = p.portfolio
        JOIN px USING (position_id) WHERE p.entry_price * p.size * 20 * (px.bars_held + 1) <= c.cash_usd GROUP BY 1"""),
)
def cash_admission(spark, sf_dir):
    held, _, cash, done = book(spark, sf_dir)
    columns = ["portfolio", F.col("entry_price").alias("price"), (F.col("size") * 20 * (F.col("bars_held") + 1)).alias("size")]
    orders = held.select(*columns).unionByName(done.select(*columns))
    return portfolio.affordable(orders, cash).groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"))


RECON = """
held AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
           sum(l_quantity) AS size, max(l_extendedprice) AS entry_price, count(*) AS fills FROM lineitem GROUP BY 1, 2),
l AS (SELECT * FROM held WHERE fills % 5 <> 0),
x AS (SELECT symbol, side, size + CASE WHEN fills % 3 = 0 THEN 1.5 ELSE 0.00005 END AS size, entry_price FROM held WHERE fills % 7 <> 0),
cmp AS (SELECT coalesce(l.symbol, x.symbol) AS symbol, coalesce(l.side, x.side) AS side, l.size AS ls, x.size AS xs, l.entry_price AS lp, x.entry_price AS xp,
   CASE WHEN x.symbol IS NULL THEN 'stale' WHEN l.symbol IS NULL THEN 'missing' WHEN abs(x.size - l.size) > 0.0001 THEN 'resized' ELSE 'ok' END AS status
  FROM l FULL JOIN x ON l.symbol = x.symbol AND l.side = x.side)"""


@query(
    "j6_discrepancies",
    with_(RECON, select="""SELECT symbol, side, status, CASE status WHEN 'stale' THEN 'Local position ' || symbol || ' ' || side || ' not found on exchange'
        WHEN 'missing' THEN 'Exchange position ' || symbol || ' ' || side || ' missing locally'
        ELSE 'Size mismatch for ' || symbol || ': local=' || ls || ', exchange=' || xs END AS message FROM cmp WHERE status <> 'ok'"""),
)
def discrepancies(spark, sf_dir):
    return reconcile.discrepancies(reconcile.compare_positions(*tables.local_exchange(spark, sf_dir)))


@query(
    "j6_reconciled_positions",
    with_(RECON, select="""SELECT symbol, side, round(CASE WHEN status = 'ok' THEN ls ELSE xs END, 6) AS size, coalesce(lp, xp) AS entry_price,
        CASE WHEN status = 'missing' THEN 0e0 END AS tp_price, CASE WHEN status = 'missing' THEN 0e0 END AS sl_price,
        CASE WHEN status = 'missing' THEN 'recovered_' || symbol || '_' || side END AS position_id FROM cmp WHERE status <> 'stale'"""),
)
def reconciled_positions(spark, sf_dir):
    out = reconcile.reconciled(reconcile.compare_positions(*tables.local_exchange(spark, sf_dir)))
    return out.select("symbol", "side", r("size"), "entry_price", "tp_price", "sl_price", "position_id")
