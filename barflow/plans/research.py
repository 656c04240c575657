"""Queries: backtest, bootstrap, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import stats
from barflow.operators import backtest, bootstrap, cv, features
from barflow.operators.series import LocalOp, apply_local
from barflow.plans.registry import query, r
from barflow.plans.sqlparts import BARS, with_
from barflow.sources import tables

# The traded instrument is the 1/14 moving average of the close; the signal follows the last bar.
SERIES = """
sm AS (
  SELECT symbol, bar_idx, close AS v FROM ib WHERE bar_idx = 0
  UNION ALL
  SELECT b.symbol, b.bar_idx, s.v * (13e0 / 14) + b.close / 14e0 FROM sm s JOIN ib b ON b.symbol = s.symbol AND b.bar_idx = s.bar_idx + 1),
ser AS (SELECT ib.symbol, ib.bar_idx, ib.n_bars, v AS close, CASE WHEN ib.bar_idx < 10 THEN NULL WHEN ib.close > ib.open * 2 THEN 1 WHEN ib.close * 2 < ib.open THEN -1 ELSE 0 END AS signal,
   avg(ib.volume) OVER (PARTITION BY ib.symbol ORDER BY ib.bar_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vma
  FROM ib JOIN sm ON sm.symbol = ib.symbol AND sm.bar_idx = ib.bar_idx),
pos AS (SELECT symbol, bar_idx, close, vma, coalesce(signal, 0) AS signal FROM ser),
lg AS (SELECT *, lag(signal) OVER w AS ps, lag(close) OVER w AS pc FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
nt AS (SELECT symbol, bar_idx, coalesce(ps, 0) AS position, coalesce(abs(signal - ps), 0) AS turnover, coalesce(ps, 1) <> 0 AS active,
   coalesce(close / pc - 1, 0) * coalesce(ps, 0) AS gross,
   coalesce(abs(signal - ps), 0) * 0.00001 * close * 0.0007 + (CASE WHEN vma > 0 THEN 0.0001 * sqrt(0.00001 / vma) ELSE 0 END) * coalesce(abs(signal - ps), 0) AS cost FROM lg),
eq AS (SELECT *, gross - cost AS net, 10000 * product(1 + gross - cost) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS equity FROM nt),
dd AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS peak FROM eq)"""

SIZE = 0.00001


def traded_series(spark, sf_dir):
    def apply(df, w):
        df = features.ewm(df, smoothed, w)
        raw = F.when(F.col("close") > F.col("open") * 2, 1).when(F.col("close") * 2 < F.col("open"), -1).otherwise(0)
        df = df.withColumn("signal", F.when(F.col("bar_idx") >= 10, raw))
        return df.withColumn("close", F.col("_smooth")).drop("_smooth")

    smoothed = features.ewm_state("_smooth", lambda w: F.col("close"), 1.0 / 14)
    smooth = LocalOp(1, 0, apply, (smoothed,))
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.volume_average(20), smooth)
    return out.select("symbol", "ts", "bar_idx", "signal", "close", "vma", F.lit(SIZE).alias("size"))


def _net(spark, sf_dir):
    return apply_local(traded_series(spark, sf_dir), backtest.net_return_op())


@query("w15_position_lag", with_(BARS, SERIES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(position AS INTEGER) AS position FROM nt"))
def position_lag(spark, sf_dir):
    return _net(spark, sf_dir).select("symbol", "bar_idx", "position")


@query("w16_gross_return", with_(BARS, SERIES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(gross, 8) + 0e0 AS gross FROM nt"))
def gross_return(spark, sf_dir):
    return _net(spark, sf_dir).select("symbol", "bar_idx", (F.round("gross", 8) + F.lit(0.0)).alias("gross"))


@query(
    "w17_turnover_cost",
    with_(BARS, SERIES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(turnover AS DOUBLE) AS turnover, round(cost, 10) AS cost FROM nt"),
)
def turnover_cost(spark, sf_dir):
    return _net(spark, sf_dir).select("symbol", "bar_idx", "turnover", r("cost", 10))


@query("w18_equity_curve", with_(BARS, SERIES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(equity, 4) AS equity FROM eq"))
def equity_curve(spark, sf_dir):
    return backtest.equity_curve(traded_series(spark, sf_dir)).select("symbol", "bar_idx", r("equity", 4))


@query(
    "w19_drawdown",
    with_(BARS, SERIES, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(peak, 4) AS peak, round((equity - peak) / peak, 8) + 0e0 AS drawdown FROM dd"),
)
def drawdown(spark, sf_dir):
    out = backtest.drawdown(backtest.equity_curve(traded_series(spark, sf_dir)))
    return out.select("symbol", "bar_idx", r("peak", 4), (F.round("drawdown", 8) + F.lit(0.0)).alias("drawdown"))


@query(
    "e11_slippage",
    with_(BARS, select="SELECT symbol, epoch_us(ts) AS ts_us, round(CASE WHEN volume - 50 > 0 THEN 0.0001 * sqrt(abs(open - close) / (volume - 50)) ELSE 0 END, 8) AS slip FROM bars"),
)
def slippage(spark, sf_dir):
    slip = backtest.slippage(F.col("open") - F.col("close"), F.col("volume") - 50.0)
    return tables.daily_bars(spark, sf_dir).select("symbol", F.unix_micros("ts").alias("ts_us"), F.round(slip, 8).alias("slip"))


SUMMARY = """
su AS (SELECT symbol, arg_max(equity, bar_idx) / arg_min(equity, bar_idx) - 1 AS total_return, count(*) AS n,
   CASE WHEN stddev_samp(net) = 0 THEN 0 ELSE avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe_ratio, abs(min((equity - peak) / peak)) AS max_drawdown,
   CAST(floor(sum(turnover) / 2) AS BIGINT) AS total_trades, count(*) FILTER (active AND net > 0) / count(*) FILTER (active) AS win_rate,
   sum(cost) AS cost_usd, coalesce(skewness(net), 0) AS skew, coalesce(kurtosis(net), 0) AS kurtosis FROM dd GROUP BY 1),
zs AS (SELECT *, CASE WHEN sharpe_ratio > 0 THEN sharpe_ratio / sqrt(n) ELSE 0.01 END AS sd, sqrt(2 * ln(n)) AS l FROM su),
zz AS (SELECT *, (sharpe_ratio - (l - (0.5772 + ln(2 * pi())) / (2 * l)) * sd) /
   (sd * sqrt(greatest(1 - skew * sharpe_ratio + (kurtosis - 3) * sharpe_ratio * sharpe_ratio / 4, 1e-6))) AS dsr_z FROM zs)"""


def _summary(spark, sf_dir):
    summary, _ = backtest.run_backtest(traded_series(spark, sf_dir))
    return summary


@query(
    "a10_backtest_summary",
    with_(BARS, SERIES, SUMMARY, select="""SELECT symbol, round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown, total_trades,
        round(win_rate, 6) AS win_rate, round(cost_usd, 6) AS cost_usd FROM su"""),
)
def backtest_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "symbol", r("total_return"), r("max_drawdown"), "total_trades", r("win_rate"), r("cost_usd")
    )


@query("a11_sharpe", with_(BARS, SERIES, SUMMARY, select="SELECT symbol, round(sharpe_ratio, 6) AS sharpe_ratio FROM su"))
def sharpe(spark, sf_dir):
    return _net(spark, sf_dir).groupBy("symbol").agg(F.round(stats.sharpe(F.col("net")), 6).alias("sharpe_ratio"))


@query("a12_moments", with_(BARS, SERIES, SUMMARY, select="SELECT symbol, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM su"))
def moments(spark, sf_dir):
    return _net(spark, sf_dir).groupBy("symbol").agg(
        F.round(stats.unbiased_skew(F.col("net")), 6).alias("skew"),
        F.round(stats.unbiased_kurtosis(F.col("net")), 6).alias("kurtosis"),
    )


@query("a13_deflated_sharpe_z", with_(BARS, SERIES, SUMMARY, select="SELECT symbol, round(dsr_z, 6) AS dsr_z FROM zz"))
def deflated_sharpe_z(spark, sf_dir):
    return _summary(spark, sf_dir).select("symbol", r("dsr_z"))


PHI = """
ph AS (SELECT symbol, dsr_z AS z, 0 AS k, dsr_z AS t FROM zz UNION ALL SELECT symbol, z, k + 1, t * z * z / (2 * k + 3) FROM ph WHERE k < 200 AND abs(z) < 8)"""


@query(
    "a13_deflated_sharpe",
    with_(BARS, SERIES, SUMMARY, PHI, select="""SELECT symbol, round(CASE WHEN z >= 8 THEN 1 WHEN z <= -8 THEN 0
        ELSE 0.5e0 + exp(-z * z / 2) / sqrt(2 * pi()) * sum(t) END, 6) AS deflated_sharpe FROM ph GROUP BY symbol, z"""),
)
def deflated_sharpe(spark, sf_dir):
    """Probability form; the SQL sums the series of the normal distribution function."""
    return _summary(spark, sf_dir).select("symbol", r("deflated_sharpe"))


# ------------------------------------------------------------------ bootstrap
REPS, BLOCK, SEED = 1000, 10, 42


def _u(tag: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|{tag}|' || {key}), 1, 8) AS BIGINT) / 4294967296e0"


BOOT = f"""
ret AS (SELECT symbol, bar_idx - 1 AS i, n_bars - 1 AS n, ln(close / pc) AS x FROM ib WHERE bar_idx >= 1),
cand AS (SELECT symbol, n, i AS start, rep FROM ret CROSS JOIN (SELECT range AS rep FROM range(0, {REPS}))),
st AS (SELECT * FROM cand WHERE start = 0 OR {_u('cut', "symbol || '|' || rep || '|' || start")} < 1e0 / {BLOCK}),
bl AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY symbol, rep ORDER BY start), n) - start AS len FROM st),
blocks AS (SELECT *, CAST(floor({_u('place', "symbol || '|' || rep || '|' || start")} * (n - len + 1)) AS BIGINT) AS source FROM bl),
res AS (SELECT b.symbol, b.rep, r.x FROM (SELECT symbol, rep, source, unnest(range(0, len)) AS o FROM blocks) b JOIN ret r ON r.symbol = b.symbol AND r.i = b.source + b.o)"""


def returns(spark, sf_dir):
    """Daily log returns per symbol, indexed from 0."""
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.log_return())
    kept = out.where(F.col("bar_idx") >= 1)
    return kept.select("symbol", (F.col("bar_idx") - 1).alias("bar_idx"), "log_return")


@query(
    "m11_block_bootstrap",
    with_(BARS, BOOT, select="SELECT symbol, CAST(rep AS INTEGER) AS rep, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len, source FROM blocks"),
)
def block_bootstrap(spark, sf_dir):
    return bootstrap.draw_blocks(returns(spark, sf_dir), REPS, BLOCK, SEED)


@query(
    "m12_bootstrap_statistic",
    with_(BARS, BOOT, select="SELECT symbol, CAST(rep AS INTEGER) AS rep, round(avg(x), 8) AS stat FROM res GROUP BY 1, 2"),
)
def bootstrap_statistic(spark, sf_dir):
    out = bootstrap.bootstrap_statistic(returns(spark, sf_dir), "log_return", F.avg, REPS, BLOCK, SEED)
    return out.select("symbol", "rep", r("stat", 8))


BOOT_CI = """
rs AS (SELECT symbol, rep, CASE WHEN stddev_samp(x) = 0 THEN 0 ELSE avg(x) / stddev_samp(x) END AS stat FROM res GROUP BY 1, 2),
ob AS (SELECT symbol, CASE WHEN stddev_samp(x) = 0 THEN 0 ELSE avg(x) / stddev_samp(x) END AS observed FROM ret GROUP BY 1)"""


@query(
    "a14_bootstrap_interval",
    with_(BARS, BOOT, BOOT_CI, select="""SELECT symbol, round(observed, 8) AS observed, round(quantile_cont(stat, 0.025), 8) AS ci_lower,
        round(quantile_cont(stat, 0.975), 8) AS ci_upper, round(avg(CASE WHEN abs(stat) >= abs(observed) THEN 1e0 ELSE 0e0 END), 6) AS p_value
        FROM rs JOIN ob USING (symbol) GROUP BY symbol, observed"""),
)
def bootstrap_interval(spark, sf_dir):
    out = bootstrap.bootstrap_sharpe(
        returns(spark, sf_dir), "log_return", n_bootstrap=REPS, block_len=BLOCK, seed=SEED
    )
    return out.select("symbol", r("observed", 8), r("ci_lower", 8), r("ci_upper", 8), r("p_value"))


@query(
    "a15_bootstrap_sharpe",
    with_(BARS, BOOT, BOOT_CI, select="SELECT symbol, CAST(rep AS INTEGER) AS rep, round(stat, 8) AS stat FROM rs"),
)
def bootstrap_sharpe(spark, sf_dir):
    out = bootstrap.bootstrap_statistic(
        returns(spark, sf_dir), "log_return", lambda x: stats.sharpe(x, periods=None), REPS, BLOCK, SEED
    )
    return out.select("symbol", "rep", r("stat", 8))


# ------------------------------------------------------------------ cross-validation
@query(
    "m1_purged_folds",
    with_(BARS, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(fold AS INTEGER) AS fold,
        CASE WHEN bar_idx >= a AND bar_idx < b THEN 'test' WHEN bar_idx >= b AND bar_idx < b + 20 THEN 'embargo' ELSE 'train' END AS role FROM (
        SELECT symbol, bar_idx, fold, fold * (n_bars // 5) AS a, CASE WHEN fold = 4 THEN n_bars ELSE (fold + 1) * (n_bars // 5) END AS b
        FROM ib CROSS JOIN (SELECT range AS fold FROM range(0, 5)))"""),
)
def purged_folds(spark, sf_dir):
    return cv.purged_folds(tables.indexed_daily(spark, sf_dir), 5, 20)


@query(
    "u2_train_complement",
    with_(BARS, select="""SELECT symbol, CAST(fold AS INTEGER) AS fold, count(*) AS n_train, CAST(sum(bar_idx) AS BIGINT) AS idx_sum FROM (
        SELECT symbol, fold, unnest(list_filter(range(0, n), lambda i: NOT (i >= fold * (n // 4) AND i < CASE WHEN fold = 3 THEN n ELSE (fold + 1) * (n // 4) END + 50))) AS bar_idx
        FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) CROSS JOIN (SELECT range AS fold FROM range(0, 4))) GROUP BY 1, 2"""),
)
def train_complement(spark, sf_dir):
    out = cv.purged_folds(tables.indexed_daily(spark, sf_dir), 4, 50).where(F.col("role") == "train")
    return out.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n_train"), F.sum("bar_idx").alias("idx_sum"))


@query(
    "m2_walk_forward",
    with_(BARS, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, CAST(f AS INTEGER) AS fold, CASE WHEN bar_idx < f * 100 + 500 THEN 'train' ELSE 'test' END AS role
        FROM ib CROSS JOIN (SELECT range AS f FROM range(0, 1000)) WHERE f * 100 + 750 <= n_bars AND bar_idx >= f * 100 AND bar_idx < f * 100 + 750"""),
)
def walk_forward(spark, sf_dir):
    return cv.walk_forward(tables.indexed_daily(spark, sf_dir), 500, 250, 100)


GRID = {"threshold": [-0.5, 0.0, 0.5], "sign": [1, -1]}
GRID_SQL = """
lab AS (SELECT symbol, bar_idx, n_bars, ln(close / pc) AS x, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY bar_idx) > close THEN 1 ELSE -1 END AS label FROM ib),
grid AS (SELECT threshold, sign FROM (VALUES (-0.5e0), (0e0), (0.5e0)) t(threshold) CROSS JOIN (VALUES (1), (-1)) s(sign)),
sc AS (SELECT symbol, threshold, sign, least(bar_idx // (n_bars // 5), 4) AS fold,
   avg(CASE WHEN sign * CASE WHEN coalesce(x, 0) > threshold THEN 1 ELSE -1 END = label THEN 1e0 ELSE 0e0 END) AS score FROM lab CROSS JOIN grid GROUP BY 1, 2, 3, 4)"""


def momentum_labels(spark, sf_dir):
    """Last return as input, direction of the next close as label."""
    def apply(df, w):
        up = F.lead("close").over(w) > F.col("close")
        return df.withColumn("label", F.when(up, 1).otherwise(-1))

    out = apply_local(tables.indexed_daily(spark, sf_dir), features.log_return(), LocalOp(0, 1, apply))
    return out.select("symbol", "bar_idx", F.coalesce("log_return", F.lit(0.0)).alias("x"), "label")


@query(
    "m4_parameter_grid",
    with_(BARS, GRID_SQL, select="""SELECT symbol, threshold, CAST(sign AS INTEGER) AS sign, round(avg(score), 8) AS mean_score, round(stddev_pop(score), 8) AS std_score,
        """ + ", ".join(f"round(max(CASE WHEN fold = {i} THEN score END), 8) AS fold_{i}" for i in range(5)) + " FROM sc GROUP BY 1, 2, 3"),
)
def parameter_grid(spark, sf_dir):
    predict = F.col("sign") * F.when(F.col("x") > F.col("threshold"), 1).otherwise(-1)
    out = cv.rule_grid(momentum_labels(spark, sf_dir), GRID, predict, 5)
    return out.select("symbol", "threshold", "sign", *[r(c, 8) for c in out.columns[3:]])


@query(
    "a5_fold_summary",
    with_(BARS, GRID_SQL, select="""SELECT symbol, round(avg(score), 8) AS mean_score, round(stddev_pop(score), 8) AS std_score,
        """ + ", ".join(f"round(max(CASE WHEN fold = {i} THEN score END), 8) AS fold_{i}" for i in range(5)) + " FROM sc WHERE threshold = 0 AND sign = 1 GROUP BY 1"),
)
def fold_summary(spark, sf_dir):
    predict = F.when(F.col("x") > 0, 1).otherwise(-1)
    out = cv.rule_grid(momentum_labels(spark, sf_dir), {"rule": [0]}, predict, 5).drop("rule")
    return out.select("symbol", *[r(c, 8) for c in out.columns[1:]])


@query(
    "a4_accuracy",
    with_(BARS, GRID_SQL, select="SELECT symbol, round(avg(CASE WHEN CASE WHEN coalesce(x, 0) > 0 THEN 1 ELSE -1 END = label THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM lab GROUP BY 1"),
)
def accuracy(spark, sf_dir):
    predict = F.when(F.col("x") > 0, 1).otherwise(-1)
    return momentum_labels(spark, sf_dir).groupBy("symbol").agg(F.round(stats.accuracy(predict, F.col("label")), 8).alias("accuracy"))


@query(
    "m9_chronological_split",
    with_(BARS, GRID_SQL, select="""SELECT symbol, bar_idx < floor(0.8 * n_bars) AS in_sample, count(*) AS n,
        round(avg(CASE WHEN CASE WHEN coalesce(x, 0) > 0 THEN 1 ELSE -1 END = label THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM lab GROUP BY 1, 2"""),
)
def chronological_split(spark, sf_dir):
    predict = F.when(F.col("x") > 0, 1).otherwise(-1)
    out = cv.chronological_split(momentum_labels(spark, sf_dir), 0.8)
    return out.groupBy("symbol", "in_sample").agg(
        F.count(F.lit(1)).alias("n"), F.round(stats.accuracy(predict, F.col("label")), 8).alias("accuracy")
    )
