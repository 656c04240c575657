"""Queries that write tables and read them back (S3, S6-S8, S10, S12 with E16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barflow.plans.registry import query, r, us
from barflow.plans.sqlparts import BARS, with_
from barflow.schemas import OHLCV
from barflow.session import shared_dir
from barflow.sources import bars as scans
from barflow.sources import sinks, snapshots, tables


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BAR_SELECT = "SELECT symbol, epoch_us(ts) AS ts_us, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM "


def _bar_columns(df, ts="ts"):
    return df.select("symbol", us(ts, "ts_us"), *[r(c, 4) for c in OHLCV])


@query("s3_provider_columns", with_(BARS, select=BAR_SELECT + "bars WHERE volume > 100"))
def provider_columns(spark, sf_dir):
    """Bars under a two-level header in mixed case, some rows incomplete."""
    daily = tables.daily_bars(spark, sf_dir)
    headed = [F.struct(F.col(c).alias("AAA")).alias(c.title()) for c in OHLCV[:4]]
    volume = F.struct(F.when(F.col("volume") > 100, F.col("volume")).alias("AAA")).alias("VOLUME")
    return _bar_columns(scans.normalize_columns(daily.select("symbol", F.col("ts").alias("TS"), *headed, volume, F.lit(1).alias("Adj"))))


@query("s6_snapshot_files", with_(BARS, select=BAR_SELECT + "(SELECT * FROM bars UNION ALL SELECT * FROM bars)"))
def snapshot_files(spark, sf_dir):
    """The bars as CSV and as parquet, both read back."""
    daily = tables.daily_bars(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    folder = _folder(spark, "snapshots")
    parts = []
    for ending in ("csv", "parquet"):
        snapshots.write_snapshot(daily, f"{folder}/bars.{ending}")
        parts.append(_bar_columns(snapshots.read_snapshot(spark, f"{folder}/bars.{ending}"), "timestamp"))
    return parts[0].unionByName(parts[1])


@query("s7_fresh_snapshot", with_(BARS, select="SELECT 'fresh' AS bound, count(*) AS n FROM bars UNION ALL SELECT 'stale', 0 UNION ALL SELECT 'missing', 0"))
def fresh_snapshot(spark, sf_dir):
    """Rows that a read with an age bound gives: all of the table or nothing."""
    path = f"{_folder(spark, 'snapshots')}/bars.parquet"
    daily = tables.daily_bars(spark, sf_dir)
    snapshots.write_snapshot(daily.repartition(4), path)
    found = {
        "fresh": snapshots.read_snapshot(spark, path, max_age_seconds=3600),
        "stale": snapshots.read_snapshot(spark, path, max_age_seconds=0),
        "missing": snapshots.read_snapshot(spark, path + ".not", max_age_seconds=3600),
    }
    parts = [(daily.limit(0) if df is None else df).groupBy().agg(F.lit(bound).alias("bound"), F.count(F.lit(1)).alias("n")) for bound, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _orders_as_trades(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select(
        tables.utc("o_orderdate").alias("entry_time"),
        F.date_trunc("month", tables.utc("o_orderdate")).alias("exit_time"),
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("pnl_usd"),
        F.col("o_orderkey").cast("string").alias("position_id"),
        F.col("o_orderstatus").alias("unknown"),
    )


@query(
    "s8_trade_log",
    """SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS exit_date, o_orderpriority AS symbol, count(*) * 2 AS n, count(*) AS with_pnl,
       round(sum(o_totalprice), 2) AS pnl_usd, 0 AS with_side FROM orders GROUP BY 1, 2""",
)
def trade_log(spark, sf_dir):
    """Trades appended twice, the second time without a column."""
    path = _folder(spark, "trades")
    trades = _orders_as_trades(spark, sf_dir)
    sinks.append_trades(trades, path)
    sinks.append_trades(trades.drop("pnl_usd"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("exit_date").cast("string").alias("exit_date"), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("pnl_usd").alias("with_pnl"), F.round(F.sum("pnl_usd"), 2).alias("pnl_usd"), F.count("side").alias("with_side")
    )


@query(
    "s10_evolution_log",
    """SELECT l_returnflag AS trigger, count(*) AS n_samples, round(avg(l_discount), 6) AS learning_rate, CAST(NULL AS VARCHAR) AS notes FROM lineitem GROUP BY 1
       UNION ALL SELECT l_linestatus, count(*), NULL, 'status' FROM lineitem GROUP BY 1""",
)
def evolution_log(spark, sf_dir):
    """Metric rows of two writers with different columns in one log."""
    path = _folder(spark, "evolution")
    lines = tables.table(spark, sf_dir, "lineitem")
    sinks.append_evolution(lines.groupBy(F.col("l_returnflag").alias("trigger")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("l_discount").alias("learning_rate")), path)
    sinks.append_evolution(lines.groupBy(F.col("l_linestatus").alias("trigger")).agg(F.count(F.lit(1)).alias("n_samples"), F.lit("status").alias("notes")), path)
    return spark.read.parquet(path).select("trigger", "n_samples", r("learning_rate", 6), "notes")


@query(
    "s12_portfolio_documents",
    """WITH lines AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag FROM lineitem),
    cash AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS cash FROM supplier)
    SELECT s_suppkey AS account, round(coalesce(max(cash), 10000), 4) AS cash_usd, count(l_suppkey) AS positions,
      coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity / 2 ELSE l_quantity END), 0) AS remaining
    FROM cash LEFT JOIN lines ON l_suppkey = s_suppkey GROUP BY 1""",
)
def portfolio_documents(spark, sf_dir):
    """A JSON document per supplier: missing cash and remaining sizes get their defaults, unknown keys are passed over."""
    path = _folder(spark, "documents")
    lines = tables.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.struct(
            F.col("l_partkey").cast("string").alias("symbol"),
            F.lit("BUY").alias("side"),
            F.col("l_extendedprice").alias("entry_price"),
            F.col("l_quantity").alias("size"),
            F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 2).when(F.col("l_returnflag") == "R", 0.0).alias("remaining_size"),
            F.col("l_linestatus").alias("unknown"),
        ).alias("p"),
    )
    held = lines.groupBy("l_suppkey").agg(F.collect_list("p").alias("positions"))  # a supplier's lines are one document
    suppliers = tables.table(spark, sf_dir, "supplier")
    documents = suppliers.join(held, suppliers["s_suppkey"] == held["l_suppkey"], "left").select(
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("cash_usd"), "positions", F.col("s_suppkey").alias("total_trades"), F.col("s_name").alias("stray")
    )
    documents.write.json(path)
    accounts, positions = snapshots.read_state(spark, path, multi_line=False)
    sums = positions.groupBy("total_trades").agg(F.count(F.lit(1)).alias("positions"), F.sum("remaining_size").alias("remaining"))
    out = accounts.select(F.col("total_trades").alias("account"), r("cash_usd", 4)).join(sums.withColumnRenamed("total_trades", "account"), "account", "left")
    return out.select("account", "cash_usd", F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce("remaining", F.lit(0.0)).alias("remaining"))
