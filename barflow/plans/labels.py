"""Queries: barriers, regimes, fractional differences, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import barriers, containment, drift, features, fracdiff, regime
from barflow.operators.series import apply_local
from barflow.plans.registry import query, r, us
from barflow.plans.sqlparts import ATR, BARS, FEATURES, HOURLY, ROLLING_EDGES, live_labels, outcomes, with_
from barflow.session import cut_lineage
from barflow.sources import tables

LABEL_SELECT = "SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, label FROM lab"


def _live(spark, sf_dir, **options):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_atr(), barriers.live_barrier(**options))
    return out.select("symbol", "bar_idx", "label")


@query("w8_barrier_live", with_(BARS, ATR, live_labels(source="atrs"), select=LABEL_SELECT))
def barrier_live(spark, sf_dir):
    return _live(spark, sf_dir)


@query("w8_barrier_live_zero", with_(BARS, ATR, live_labels(0.5, 0.5, "0", "atrs"), select=LABEL_SELECT))
def barrier_live_zero(spark, sf_dir):
    return _live(spark, sf_dir, tp_atr=0.5, sl_atr=0.5, expiry="zero")


OUTCOME_SELECT = """SELECT symbol, CAST(entry_idx AS BIGINT) AS entry_idx, epoch_us(entry_time) AS entry_time_us,
  epoch_us(exit_time) AS exit_time_us, round(realized_return, 6) AS realized_return, label, hit_time_limit FROM """


def _outcome_columns(df):
    return df.select(
        "symbol", "entry_idx", us("entry_time"), us("exit_time"), r("realized_return"), "label", "hit_time_limit"
    )


@query("w9_barrier_research", with_(BARS, ATR, outcomes(), select=OUTCOME_SELECT + "outc"))
def barrier_research(spark, sf_dir):
    return _outcome_columns(barriers.barrier_outcomes(tables.indexed_daily(spark, sf_dir)))


@query("w9_barrier_research_tight", with_(BARS, ATR, outcomes(0.5, 0.5), select=OUTCOME_SELECT + "outc"))
def barrier_research_tight(spark, sf_dir):
    return _outcome_columns(barriers.barrier_outcomes(tables.indexed_daily(spark, sf_dir), pt_mult=0.5, sl_mult=0.5))


EVENTS_SQL = """
ev AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(o_orderdate AS TIMESTAMP) AS entry_time
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def entry_events(spark, sf_dir):
    """Order dates of all lines as entry times: repeated ones and ones without a bar included."""
    lines = tables.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), "l_orderkey"
    )
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", tables.utc("o_orderdate").alias("entry_time"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("symbol", "entry_time")


@query(
    "f3_barrier_for_events",
    with_(BARS, ATR, outcomes(), EVENTS_SQL, select=OUTCOME_SELECT + "ev JOIN outc USING (symbol, entry_time)"),
)
def barrier_for_events(spark, sf_dir):
    return _outcome_columns(barriers.barrier_outcomes(tables.indexed_daily(spark, sf_dir), events=entry_events(spark, sf_dir)))


@query(
    "j3_event_positions",
    with_(BARS, EVENTS_SQL, select="""SELECT ev.symbol, epoch_us(entry_time) AS entry_time_us, CAST(bar_idx AS BIGINT) AS bar_idx
          FROM ev JOIN ib ON ib.symbol = ev.symbol AND ib.ts = ev.entry_time"""),
)
def event_positions(spark, sf_dir):
    indexed = tables.indexed_daily(spark, sf_dir).select("symbol", F.col("ts").alias("entry_time"), "bar_idx")
    return entry_events(spark, sf_dir).join(indexed, ["symbol", "entry_time"]).select("symbol", us("entry_time"), "bar_idx")


@query(
    "j4_forward_range_join",
    with_(BARS, ATR, outcomes(0.5, 0.5, 8), EVENTS_SQL, select=OUTCOME_SELECT + "ev JOIN outc USING (symbol, entry_time)"),
)
def forward_range_join(spark, sf_dir):
    shifted = apply_local(
        cut_lineage(tables.indexed_daily(spark, sf_dir)), features.wilder_atr(warm_up=False), barriers.previous("atr", "_vol")
    )
    return _outcome_columns(barriers.sparse_outcomes(shifted, entry_events(spark, sf_dir), 0.5, 0.5, 8))


@query(
    "j5_purge_contained",
    with_(BARS, ATR, outcomes(), select="""SELECT a.symbol, CAST(a.entry_idx AS BIGINT) AS entry_idx, NOT EXISTS (
        SELECT 1 FROM outc b WHERE b.symbol = a.symbol AND b.entry_time <= a.entry_time AND b.exit_time >= a.exit_time
        AND (b.entry_time < a.entry_time OR b.exit_time > a.exit_time)) AS clean FROM outc a"""),
)
def purge_contained(spark, sf_dir):
    windows = barriers.barrier_outcomes(cut_lineage(tables.indexed_daily(spark, sf_dir)))
    return containment.purge_contained(windows).select("symbol", "entry_idx", "clean")


RANKS = """
ranks AS (
  SELECT a.symbol, a.bar_idx, a.ts, a.close, CASE WHEN a.bar_idx >= 19 THEN
    (sum(CASE WHEN b.ratr < a.ratr THEN 1 ELSE 0 END) + (sum(CASE WHEN b.ratr = a.ratr THEN 1 ELSE 0 END) + 1) / 2e0) / 20e0 END AS pct
  FROM atrs a JOIN atrs b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx - 19 AND a.bar_idx GROUP BY 1, 2, 3, 4),
regimes AS (SELECT *, CASE WHEN pct < 0.2 THEN 'LOW' WHEN pct > 0.8 THEN 'HIGH' WHEN pct IS NOT NULL THEN 'MEDIUM' END AS volatility_regime
  FROM ranks)"""


@query(
    "w10_atr_percentile",
    with_(BARS, ATR, RANKS, select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(pct, 6) AS atr_pct FROM ranks"),
)
def atr_percentile(spark, sf_dir):
    out = apply_local(tables.indexed_daily(spark, sf_dir), features.wilder_atr(warm_up=False), regime.rolling_rank("atr"))
    return out.select("symbol", "bar_idx", r("atr_pct"))


@query(
    "e12_regime_class",
    with_(BARS, ATR, RANKS, select="SELECT symbol, volatility_regime, count(*) AS n FROM regimes GROUP BY 1, 2"),
)
def regime_class(spark, sf_dir):
    out = regime.attach_regime(tables.indexed_daily(spark, sf_dir))
    return out.groupBy("symbol", "volatility_regime").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f4_regime_mask",
    with_(BARS, ATR, RANKS, select="""SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx,
        coalesce(volatility_regime IN ('LOW', 'HIGH'), false) AS edges, false AS nothing FROM regimes"""),
)
def regime_mask(spark, sf_dir):
    out = regime.attach_regime(tables.indexed_daily(spark, sf_dir), allowed=("LOW", "HIGH"))
    nothing = regime.regime_mask(F.col("volatility_regime"), ()).alias("nothing")
    return out.select("symbol", "bar_idx", F.col("tradable").alias("edges"), nothing)


@query(
    "f5_attach_regime",
    with_(BARS, ATR, RANKS, select="""SELECT symbol, epoch_us(ts) AS ts_us, close, volatility_regime,
        coalesce(volatility_regime = 'MEDIUM', false) AS tradable FROM regimes"""),
)
def attach_regime(spark, sf_dir):
    out = regime.attach_regime(tables.indexed_daily(spark, sf_dir))
    return out.select("symbol", us(), "close", "volatility_regime", "tradable")


def _frac_sql(threshold: str, d: float, source: str = "ib") -> str:
    """Weights up to the first below the threshold, or to the length of the series; computed here, not by the library."""
    return with_(
        BARS,
        f"""wt AS (SELECT 0 AS k, 1e0 AS w UNION ALL SELECT k + 1, w * (k - {d}e0) / (k + 1) FROM wt
            WHERE abs(w * (k - {d}e0) / (k + 1)) >= {threshold} AND k + 1 < (SELECT max(n_bars) FROM {source})),
        src AS (SELECT *, least(n_bars, (SELECT count(*) FROM wt)) AS width FROM {source}),
        dots AS (SELECT symbol, bar_idx + k AS bar_idx, sum(w * close) AS v FROM src JOIN wt ON k < width GROUP BY 1, 2 HAVING count(*) = max(width))""",
        select="SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(v, 4) AS frac_diff FROM dots",
    )


def _frac(df, **options):
    return fracdiff.frac_diff(df, **options).select("symbol", "bar_idx", r("frac_diff", 4))


@query("w12_frac_diff", _frac_sql("1e-4", 0.5))
def frac_diff(spark, sf_dir):
    return _frac(tables.indexed_daily(spark, sf_dir))


@query("w12_frac_diff_first", _frac_sql("1e-4", 1.0))
def frac_diff_first(spark, sf_dir):
    return _frac(tables.indexed_daily(spark, sf_dir), d=1.0)


SHORT = "(SELECT * REPLACE (symbol || '/' || (bar_idx // 100) AS symbol, bar_idx % 100 AS bar_idx, least(100, n_bars - bar_idx // 100 * 100) AS n_bars) FROM ib)"


@query("w12_frac_diff_short", _frac_sql("1e-4", 0.5, SHORT))
def frac_diff_short(spark, sf_dir):
    """Series of 100 bars, shorter than the weights: one row each."""
    bars = tables.indexed_daily(spark, sf_dir)
    part = F.floor(F.col("bar_idx") / 100)
    cut = bars.withColumn("symbol", F.concat_ws("/", "symbol", part.cast("string"))).withColumn("bar_idx", F.col("bar_idx") % 100)
    return _frac(cut)


@query(
    "w11_frac_weights",
    """WITH RECURSIVE ds AS (SELECT DISTINCT round(l_discount * 10, 1) AS d FROM lineitem),
    wt AS (SELECT d, 0 AS k, 1e0 AS w FROM ds UNION ALL SELECT d, k + 1, w * (k - d) / (k + 1) FROM wt WHERE abs(w * (k - d) / (k + 1)) >= 1e-3 AND k < 999)
    SELECT d, k, round(w, 9) AS w FROM wt""",
)
def frac_weights(spark, sf_dir):
    """Weights for every differencing degree that the discounts of the lines make."""
    degrees = tables.table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 1).alias("d")).distinct()
    weights = fracdiff.cut_weights_of(F.col("d"), 1e-3, 1000)
    return degrees.select("d", F.posexplode(weights).alias("k", "w")).select("d", "k", r("w", 9))


EDGES_SQL = """
ref AS (SELECT symbol, close FROM ib WHERE bar_idx < n_bars // 2),
qs AS (SELECT symbol, unnest(quantile_cont(close, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM ref GROUP BY 1),
edges AS (SELECT DISTINCT symbol, edge FROM qs)"""


def halves(spark, sf_dir):
    """First half of each series as reference, second half as the current sample."""
    from barflow.operators.series import with_length

    sized = with_length(cut_lineage(tables.indexed_daily(spark, sf_dir)))
    return sized.withColumn("is_ref", F.col("bar_idx") < F.floor(F.col("n_bars") / 2))


@query("a8_bin_edges", with_(BARS, EDGES_SQL, select="SELECT symbol, round(edge, 4) AS edge FROM edges"))
def bin_edges(spark, sf_dir):
    sample = halves(spark, sf_dir)
    edges = drift.bin_edges(sample.where("is_ref"), "close", ["symbol"])
    return edges.select("symbol", F.explode("inner_edges").alias("edge")).select("symbol", r("edge", 4))


@query(
    "u3_distinct_edges",
    with_(BARS, """levels AS (SELECT symbol, floor(volume / 100) AS level FROM ib),
        qs AS (SELECT symbol, unnest(quantile_cont(level, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM levels GROUP BY 1)""",
        select="SELECT symbol, count(DISTINCT edge) AS n_edges, round(max(edge), 4) AS top FROM qs GROUP BY 1"),
)
def distinct_edges(spark, sf_dir):
    levels = tables.daily_bars(spark, sf_dir).select("symbol", F.floor(F.col("volume") / 100).alias("level"))
    edges = drift.bin_edges(levels, "level", ["symbol"])
    return edges.select(
        "symbol", F.size("inner_edges").cast("bigint").alias("n_edges"), F.round(F.array_max("inner_edges"), 4).alias("top")
    )


@query(
    "a9_psi_two_sample",
    with_(BARS, EDGES_SQL, """
        binned AS (SELECT ib.symbol, bar_idx < n_bars // 2 AS is_ref, (SELECT count(*) FROM edges e WHERE e.symbol = ib.symbol AND e.edge <= ib.close) AS bin FROM ib),
        cells AS (SELECT s.symbol, k.bin, (SELECT count(*) FROM binned b WHERE b.symbol = s.symbol AND b.bin = k.bin AND b.is_ref) + 1e-6 AS p,
            (SELECT count(*) FROM binned b WHERE b.symbol = s.symbol AND b.bin = k.bin AND NOT b.is_ref) + 1e-6 AS q
          FROM (SELECT symbol, count(*) AS ne FROM edges GROUP BY 1) s JOIN (SELECT range AS bin FROM range(0, 10)) k ON k.bin <= s.ne),
        norm AS (SELECT symbol, sum(p) AS sp, sum(q) AS sq FROM cells GROUP BY 1)""",
        select="""SELECT symbol, round(sum((p / sp - q / sq) * ln((p / sp) / (q / sq))), 6) AS psi
        FROM cells JOIN norm USING (symbol) GROUP BY 1"""),
)
def psi_two_sample(spark, sf_dir):
    return drift.psi(halves(spark, sf_dir), "close", "is_ref", ["symbol"]).select("symbol", r("psi"))


@query(
    "w13_rolling_drift",
    with_(HOURLY, f"""
        ref AS (SELECT a.symbol, a.bar_idx, b.close FROM hb a JOIN hb b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx - 150 AND a.bar_idx - 51 WHERE a.bar_idx >= 150),
        tst AS (SELECT a.symbol, a.bar_idx, b.close FROM hb a JOIN hb b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx - 50 AND a.bar_idx - 1 WHERE a.bar_idx >= 150),
        qs AS (SELECT symbol, bar_idx, {ROLLING_EDGES} FROM ref GROUP BY 1, 2),
        pb AS (SELECT symbol, bar_idx, len(list_filter(inner_edges, lambda e: e <= close)) AS bin, count(*) AS n FROM ref JOIN qs USING (symbol, bar_idx) GROUP BY 1, 2, 3),
        qb AS (SELECT symbol, bar_idx, len(list_filter(inner_edges, lambda e: e <= close)) AS bin, count(*) AS n FROM tst JOIN qs USING (symbol, bar_idx) GROUP BY 1, 2, 3),
        cells AS (SELECT qs.symbol, qs.bar_idx, len(inner_edges) + 1 AS nb, unnest(range(0, len(inner_edges) + 1)) AS bin FROM qs),
        shares AS (SELECT c.symbol, c.bar_idx, (coalesce(pb.n, 0) + 1e-6) / (100 + nb * 1e-6) AS p, (coalesce(qb.n, 0) + 1e-6) / (50 + nb * 1e-6) AS q
          FROM cells c LEFT JOIN pb USING (symbol, bar_idx, bin) LEFT JOIN qb USING (symbol, bar_idx, bin)),
        psis AS (SELECT symbol, bar_idx, sum((p - q) * ln(p / q)) AS psi FROM shares GROUP BY 1, 2)""",
        select="""SELECT hb.symbol, CAST(hb.bar_idx AS BIGINT) AS bar_idx, round(psi, 6) AS psi, coalesce(psi > 0.25, false) AS drift
        FROM hb LEFT JOIN psis USING (symbol, bar_idx)"""),
)
def rolling_drift(spark, sf_dir):
    out = drift.detect_drift(tables.indexed_hourly(spark, sf_dir), "close")
    return out.select("symbol", "bar_idx", r("psi"), "drift")
