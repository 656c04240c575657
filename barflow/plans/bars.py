"""Queries: scans, bar building, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.config import Layout
from barflow.operators import asof, barriers, features, trades
from barflow.operators.series import apply_local
from barflow.plans.registry import query, r, us
from barflow.plans.sqlparts import ATR, BARS, FEATURES, HOURLY, RSI, live_labels, with_
from barflow.schemas import FEATURES as FEATURE_NAMES
from barflow.schemas import OHLCV
from barflow.sources import bars as scans
from barflow.sources import tables



@query(
    "s1_ohlcv_scan",
    with_(BARS, select="""SELECT symbol, epoch_us(ts) AS ts_us, open, high, low, close, volume
        FROM bars WHERE volume >= 25"""),
)
def ohlcv_scan(spark, sf_dir):
    raw = tables.daily_bars(spark, sf_dir).select(
        "symbol", F.unix_millis("ts").alias("ms"), *OHLCV[:4], F.when(F.col("volume") >= 25, F.col("volume")).alias("volume")
    )
    return scans.scan_ohlcv(raw).select("symbol", us(), *OHLCV)


@query(
    "s2_bars_daily",
    with_(BARS, select="SELECT symbol, epoch_us(ts) AS ts_us, open, high, low, close, volume FROM bars"),
)
def bars_daily(spark, sf_dir):
    return tables.daily_bars(spark, sf_dir).select("symbol", us(), *OHLCV)


@query(
    "s2_bars_hourly",
    with_(HOURLY, select="SELECT symbol, epoch_us(ts) AS ts_us, open, high, low, close, volume FROM hbars"),
)
def bars_hourly(spark, sf_dir):
    return tables.hourly_bars(spark, sf_dir).select("symbol", us(), *OHLCV)


@query(
    "s4_funding_scan",
    """SELECT epoch_us(date_trunc('month', CAST(o_orderdate AS TIMESTAMP))) AS ts_us,
       round(avg(o_totalprice), 4) AS funding_rate FROM orders GROUP BY 1""",
)
def funding_scan(spark, sf_dir):
    return scans.scan_funding(tables.funding_raw(spark, sf_dir)).select(us(), r("funding_rate", 4))


@query(
    "s5_open_interest_scan",
    """SELECT epoch_us(date_trunc('week', CAST(o_orderdate AS TIMESTAMP))) AS ts_us,
       CAST(count(*) AS DOUBLE) AS open_interest FROM orders GROUP BY 1""",
)
def open_interest_scan(spark, sf_dir):
    return scans.scan_open_interest(tables.open_interest_raw(spark, sf_dir)).select(us(), "open_interest")


@query(
    "k1_bar_positions",
    with_(BARS, select="SELECT symbol, epoch_us(ts) AS ts_us, CAST(bar_idx AS BIGINT) AS bar_idx, close FROM ib"),
)
def bar_positions(spark, sf_dir):
    return tables.indexed_daily(spark, sf_dir).select("symbol", us(), "bar_idx", "close")


@query(
    "k2_last_bars",
    with_(BARS, select="""SELECT symbol, epoch_us(ts) AS ts_us, close FROM
        (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 750"""),
)
def last_bars(spark, sf_dir):
    return trades.last_bars(tables.indexed_daily(spark, sf_dir), 750).select("symbol", us(), "close")


@query(
    "w22_latest_bar",
    with_(BARS, select="""SELECT b.symbol, epoch_us(b.ts) AS ts_us, open, high, low, close, volume FROM bars b
        JOIN (SELECT symbol, max(ts) AS ts FROM bars GROUP BY 1) m ON m.symbol = b.symbol AND m.ts = b.ts"""),
)
def latest_bar(spark, sf_dir):
    return trades.latest_bar(tables.daily_bars(spark, sf_dir)).select("symbol", us(), *OHLCV)


@query(
    "w1_true_range",
    with_(BARS, ATR, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(tr, 2) AS true_range FROM tr"),
)
def true_range(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.true_range())
    return out.select("symbol", "bar_idx", r("true_range", 2))


@query(
    "w2_atr_live",
    with_(BARS, ATR, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(atr, 3) AS atr FROM atrs"),
)
def atr_live(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_atr())
    return out.select("symbol", "bar_idx", r("atr", 3))


@query(
    "w3_atr_research",
    with_(BARS, ATR, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(ratr, 3) AS atr FROM atrs"),
)
def atr_research(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_atr(warm_up=False))
    return out.select("symbol", "bar_idx", r("atr", 3))


@query(
    "w4_log_return",
    with_(BARS, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(ln(close / pc), 6) AS log_return FROM ib"),
)
def log_return(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.log_return())
    return out.select("symbol", "bar_idx", r("log_return"))


@query(
    "w5_volatility_ratio",
    with_(BARS, ATR, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(atr / close, 6) AS volatility_ratio FROM atrs"),
)
def volatility_ratio(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_atr(), features.volatility_ratio())
    return out.select("symbol", "bar_idx", r("volatility_ratio"))


SHORT_RSI = """
smv AS (SELECT symbol, bar_idx, greatest(close - pc, 0) AS g, greatest(pc - close, 0) AS l FROM ib WHERE bar_idx >= 1),
sgl AS (SELECT symbol, bar_idx, g, l FROM smv WHERE bar_idx = 1
  UNION ALL SELECT m.symbol, m.bar_idx, e.g * 0.5e0 + m.g * 0.5e0, e.l * 0.5e0 + m.l * 0.5e0 FROM sgl e JOIN smv m ON m.symbol = e.symbol AND m.bar_idx = e.bar_idx + 1)"""


@query(
    "w6_wilder_rsi_short",
    with_(BARS, SHORT_RSI, select="""SELECT ib.symbol, CAST(ib.bar_idx AS BIGINT) AS bar_idx, round(CASE WHEN ib.bar_idx < 2 OR (l = 0 AND g = 0) THEN NULL
        WHEN l = 0 THEN 1 ELSE 1 - 1 / (1 + g / l) END, 6) AS norm_rsi FROM ib LEFT JOIN sgl USING (symbol, bar_idx)"""),
)
def wilder_rsi_short(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_rsi(2))
    return out.select("symbol", "bar_idx", r("norm_rsi"))


@query(
    "w6_wilder_rsi",
    with_(FEATURES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(norm_rsi, 6) AS norm_rsi FROM feats"),
)
def wilder_rsi(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_rsi())
    return out.select("symbol", "bar_idx", r("norm_rsi"))


FLAT = """
ib AS (
  SELECT symbol, ts, bar_idx, n_bars, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, volume, open, high, low, close FROM (
    SELECT * REPLACE (CASE WHEN bar_idx < 100 THEN high ELSE 50000 END AS high, CASE WHEN bar_idx < 100 THEN low ELSE 50000 END AS low,
                      CASE WHEN bar_idx < 100 THEN close ELSE 50000 END AS close) FROM moving))"""


@query(
    "w6_wilder_rsi_flat",
    with_(BARS.replace("ib AS", "moving AS"), FLAT, ATR, RSI, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(norm_rsi, 6) AS norm_rsi, atr > 0 AS moved FROM feats"),
)
def wilder_rsi_flat(spark, sf_dir):
    """Bars that stand still from the 100th on, over chunks of 256 bars."""
    late = F.col("bar_idx") >= 100
    flat = tables.indexed_daily(spark, sf_dir).withColumns({c: F.when(late, 50000.0).otherwise(F.col(c)) for c in ("high", "low", "close")})
    out = features.build_features(flat, layout=Layout(chunk_bars=256))
    return out.select("symbol", "bar_idx", r("norm_rsi"), (F.col("atr") > 0).alias("moved"))


ROUNDED = "round(log_return, 6) AS log_return, round(atr, 3) AS atr, round(volatility_ratio, 6) AS volatility_ratio, round(norm_rsi, 6) AS norm_rsi"


def rounded_features():
    return [r("log_return"), r("atr", 3), r("volatility_ratio"), r("norm_rsi")]


@query("w7_feature_build", with_(FEATURES, select=f"SELECT symbol, epoch_us(ts) AS ts_us, {ROUNDED} FROM feats"))
def feature_build(spark, sf_dir):
    out = features.build_features(tables.indexed_daily(spark, sf_dir))
    return out.select("symbol", us(), *rounded_features())


HOUR_FEATURES = with_(
    HOURLY, "ib AS (SELECT * FROM hb)", ATR, RSI,
    select=f"SELECT symbol, epoch_us(ts) AS ts_us, {ROUNDED} FROM feats",
)


@query("w7_feature_build_hourly", HOUR_FEATURES)
def feature_build_hourly(spark, sf_dir):
    out = features.build_features(tables.indexed_hourly(spark, sf_dir))
    return out.select("symbol", us(), *rounded_features())


@query(
    "w24_volume_average",
    with_(BARS, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(avg(volume) OVER
        (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS vma FROM ib"""),
)
def volume_average(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.volume_average(20))
    return out.select("symbol", "bar_idx", r("vma"))


def feature_label_frame(spark, sf_dir, expiry="null"):
    """Features and labels over one halo, the flagship plan."""
    return apply_local(
        tables.indexed_daily(spark, sf_dir), features.feature_op(), barriers.live_barrier(expiry=expiry)
    )


def label_distribution(spark, sf_dir, expiry="null"):
    clean = trades.training_rows(feature_label_frame(spark, sf_dir, expiry), columns=FEATURE_NAMES)
    return clean.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))


NOT_NULL = "log_return IS NOT NULL AND atr IS NOT NULL AND volatility_ratio IS NOT NULL AND norm_rsi IS NOT NULL AND label IS NOT NULL"


@query(
    "a3_label_distribution",
    with_(FEATURES, live_labels(), select=f"SELECT symbol, label, count(*) AS n FROM lab WHERE {NOT_NULL} GROUP BY 1, 2"),
)
def label_distribution_null(spark, sf_dir):
    return label_distribution(spark, sf_dir)


@query(
    "a3_label_distribution_zero",
    with_(FEATURES, live_labels(expiry="0"), select=f"SELECT symbol, label, count(*) AS n FROM lab WHERE {NOT_NULL} GROUP BY 1, 2"),
)
def label_distribution_zero(spark, sf_dir):
    return label_distribution(spark, sf_dir, "zero")


@query(
    "j1_features_join_labels",
    with_(FEATURES, live_labels(), select=f"SELECT symbol, epoch_us(ts) AS ts_us, {ROUNDED}, label FROM lab"),
)
def features_join_labels(spark, sf_dir):
    frame = feature_label_frame(spark, sf_dir)
    return frame.select("symbol", us(), *rounded_features(), "label")


@query(
    "f1_training_rows",
    with_(FEATURES, live_labels(), select=f"SELECT symbol, epoch_us(ts) AS ts_us, {ROUNDED}, label FROM lab WHERE {NOT_NULL}"),
)
def training_rows(spark, sf_dir):
    clean = trades.training_rows(feature_label_frame(spark, sf_dir), columns=FEATURE_NAMES)
    return clean.select("symbol", us(), *rounded_features(), "label")


@query(
    "f2_enough_samples",
    with_(FEATURES, live_labels(), select=f"SELECT symbol, count(*) AS n FROM lab WHERE {NOT_NULL} GROUP BY 1 HAVING count(*) >= 120"),
)
def enough_samples(spark, sf_dir):
    clean = trades.training_rows(feature_label_frame(spark, sf_dir), columns=FEATURE_NAMES)
    return trades.enough_samples(clean)


@query(
    "w23_rolling_train_window",
    with_(FEATURES, live_labels(), select=f"""SELECT symbol, epoch_us(ts) AS ts_us, label,
        CAST(i AS BIGINT) AS row_idx, n - i <= 1000 AS in_window, i % 100 = 0 AS retrain FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
               count(*) OVER (PARTITION BY symbol) AS n FROM lab WHERE {NOT_NULL})"""),
)
def rolling_train_window(spark, sf_dir):
    clean = trades.training_rows(feature_label_frame(spark, sf_dir), columns=FEATURE_NAMES)
    return trades.rolling_train_window(clean).select("symbol", us(), "label", "row_idx", "in_window", "retrain")


ASOF_SOURCES = """
fr AS (SELECT date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS ts,
              CASE WHEN count(*) % 4 = 0 THEN NULL ELSE avg(o_totalprice) END AS funding_rate FROM orders GROUP BY 1),
oi AS (SELECT date_trunc('week', CAST(o_orderdate AS TIMESTAMP)) AS ts, CAST(count(*) AS DOUBLE) AS open_interest
       FROM orders GROUP BY 1)"""


@query(
    "j2_asof_align",
    with_(BARS, ASOF_SOURCES, select="""SELECT b.symbol, epoch_us(b.ts) AS ts_us, close,
        round(funding_rate, 4) AS funding_rate, open_interest
        FROM bars b ASOF LEFT JOIN fr ON b.ts >= fr.ts ASOF LEFT JOIN oi ON b.ts >= oi.ts"""),
)
def asof_align(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    month = F.date_trunc("month", tables.utc("o_orderdate")).alias("ts")
    mean = F.when(F.count(F.lit(1)) % 4 != 0, F.avg("o_totalprice"))
    funding = orders.groupBy(month).agg(mean.alias("funding_rate"))
    interest = scans.scan_open_interest(tables.open_interest_raw(spark, sf_dir))
    out = asof.align(tables.daily_bars(spark, sf_dir), funding, interest, keys=())
    return out.select("symbol", us(), "close", r("funding_rate", 4), "open_interest")


@query(
    "j2_asof_by_symbol",
    with_(HOURLY, select="""SELECT b.symbol, epoch_us(b.ts) AS ts_us, b.close, t.value AS last_price,
        CAST(t.event_id AS BIGINT) AS last_event
        FROM hbars b ASOF LEFT JOIN events t ON b.symbol = t.event_type AND b.ts >= CAST(t.ts AS TIMESTAMP)"""),
)
def asof_by_symbol(spark, sf_dir):
    ticks = tables.event_ticks(spark, sf_dir).select("symbol", "ts", F.col("price").alias("last_price"), F.col("event_id").alias("last_event"))
    out = asof.asof_backward(
        tables.hourly_bars(spark, sf_dir), ticks, ["last_price", "last_event"], timeframe_us=3_600_000_000, on_grid=True
    )
    return out.select("symbol", us(), "close", "last_price", "last_event")


@query(
    "j11_reindex_fill",
    with_(BARS, """
        prices AS (SELECT symbol, ts, close AS px FROM bars WHERE volume >= 100),
        joined AS (SELECT ib.symbol, ib.bar_idx, p.px FROM ib LEFT JOIN prices p ON p.symbol = ib.symbol AND p.ts = ib.ts)""",
        select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, coalesce(
        last_value(px IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(px IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS px
        FROM joined"""),
)
def reindex_fill(spark, sf_dir):
    timeline = tables.indexed_daily(spark, sf_dir)
    known = tables.daily_bars(spark, sf_dir).where(F.col("volume") >= 100).select("symbol", "ts", F.col("close").alias("px"))
    return asof.reindex_to(timeline.select("symbol", "ts", "bar_idx"), known, ["px"]).select("symbol", "bar_idx", "px")
