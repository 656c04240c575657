"""Common table expressions of the comparison SQL."""

TUPLE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

BARS = f"""
bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
         first(l_extendedprice ORDER BY {TUPLE}) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {TUPLE}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
ib AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx,
         count(*) OVER (PARTITION BY symbol) AS n_bars,
         lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc
  FROM bars)"""

HOURLY = """
hbars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2),
hb AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx,
         count(*) OVER (PARTITION BY symbol) AS n_bars,
         lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc
  FROM hbars)"""

ATR = """
tr AS (
  SELECT symbol, bar_idx, CASE WHEN pc IS NULL THEN high - low
         ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM ib),
ewm AS (
  SELECT symbol, bar_idx, tr AS v FROM tr WHERE bar_idx = 0
  UNION ALL
  SELECT t.symbol, t.bar_idx, e.v * (13e0 / 14) + t.tr / 14e0
  FROM ewm e JOIN tr t ON t.symbol = e.symbol AND t.bar_idx = e.bar_idx + 1),
atrs AS (
  SELECT ib.*, v AS ratr, CASE WHEN ib.bar_idx >= 13 THEN v END AS atr
  FROM ib JOIN ewm USING (symbol, bar_idx))"""

RSI = """
mv AS (
  SELECT symbol, bar_idx, greatest(close - pc, 0) AS g, greatest(pc - close, 0) AS l
  FROM ib WHERE bar_idx >= 1),
gl AS (
  SELECT symbol, bar_idx, g, l FROM mv WHERE bar_idx = 1
  UNION ALL
  SELECT m.symbol, m.bar_idx, e.g * (13e0 / 14) + m.g / 14e0, e.l * (13e0 / 14) + m.l / 14e0
  FROM gl e JOIN mv m ON m.symbol = e.symbol AND m.bar_idx = e.bar_idx + 1),
feats AS (
  SELECT a.*, ln(a.close / a.pc) AS log_return, a.atr / a.close AS volatility_ratio,
         CASE WHEN gl.bar_idx < 14 OR gl.bar_idx IS NULL THEN NULL
              WHEN gl.l = 0 AND gl.g > 0 THEN 1.0
              WHEN gl.l = 0 THEN NULL
              ELSE 1 - 1 / (1 + gl.g / gl.l) END AS norm_rsi
  FROM atrs a LEFT JOIN gl USING (symbol, bar_idx))"""

FEATURES = BARS + "," + ATR + "," + RSI


def live_labels(tp: float = 1.5, sl: float = 1.0, expiry: str = "NULL", source: str = "feats") -> str:
    """Live triple barrier by a self join on the next five bars."""
    return f"""
touch AS (
  SELECT a.symbol, a.bar_idx, min(b.bar_idx) AS hit
  FROM {source} a JOIN {source} b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + 5
   AND (b.high >= a.close + {tp} * a.atr OR b.low <= a.close - {sl} * a.atr)
  GROUP BY 1, 2),
lab AS (
  SELECT a.*, CAST(CASE WHEN a.atr IS NULL OR a.bar_idx + 5 >= a.n_bars THEN NULL
         WHEN t.hit IS NULL THEN {expiry}
         WHEN h.high >= a.close + {tp} * a.atr THEN 1 ELSE -1 END AS INTEGER) AS label
  FROM {source} a LEFT JOIN touch t USING (symbol, bar_idx)
  LEFT JOIN {source} h ON h.symbol = a.symbol AND h.bar_idx = t.hit)"""


def outcomes(tp: float = 1.5, sl: float = 1.0, hold: int = 5) -> str:
    """Research triple barrier by a self join; needs ``atrs``."""
    return f"""
vols AS (
  SELECT *, lag(ratr) OVER (PARTITION BY symbol ORDER BY bar_idx) AS vol FROM atrs),
rhit AS (
  SELECT a.symbol, a.bar_idx, min(b.bar_idx) AS hit
  FROM vols a JOIN vols b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + {hold}
   AND (b.high >= a.close + {tp} * a.vol OR b.low <= a.close - {sl} * a.vol)
  GROUP BY 1, 2),
outc AS (
  SELECT a.symbol, a.bar_idx AS entry_idx, x.bar_idx AS exit_idx, a.close AS entry_price,
         a.ts AS entry_time, x.ts AS exit_time, x.close / a.close - 1 AS realized_return,
         CAST(CASE WHEN h.hit IS NULL THEN sign(x.close / a.close - 1)
              WHEN x.high >= a.close + {tp} * a.vol AND x.low <= a.close - {sl} * a.vol
                THEN CASE WHEN x.close >= a.close THEN 1 ELSE -1 END
              WHEN x.high >= a.close + {tp} * a.vol THEN 1 ELSE -1 END AS INTEGER) AS label,
         h.hit IS NULL AS hit_time_limit
  FROM vols a LEFT JOIN rhit h USING (symbol, bar_idx)
  JOIN vols x ON x.symbol = a.symbol
   AND x.bar_idx = coalesce(h.hit, least(a.bar_idx + {hold}, a.n_bars - 1))
  WHERE a.vol IS NOT NULL)"""


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts) + "\n" + select

#: Inner edges of ten bins of a hundred ``close``: between two neighbours, left + (right - left) * part, as the queries have it. An edge
#: may fall on a value of the other sample, so the last bit of it decides; ``quantile_cont`` leaves that bit to the engine.
ROLLING_EDGES = """list_sort(list_distinct(list_transform(range(1, 10), lambda k: list_sort(list(close))[CAST(floor(k / 10e0 * 99) AS INTEGER) + 1]
      + (list_sort(list(close))[CAST(floor(k / 10e0 * 99) AS INTEGER) + 2] - list_sort(list(close))[CAST(floor(k / 10e0 * 99) AS INTEGER) + 1]) * (k / 10e0 * 99 - floor(k / 10e0 * 99))))) AS inner_edges"""
