"""Adapters that read the TPC-H-like test tables as market data (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators.series import DAY_US, HOUR_US, index_bars
from barflow.session import cut_lineage, spread, use_utc
from barflow.sources.bars import ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(name: str):
    return F.col(name).cast("timestamp")


# Ticks of one day have no time part; this tuple fixes their order.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        utc("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("size"),
        *LINE_ORDER,
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(spread(daily_ticks(spark, sf_dir)), "1 day", LINE_ORDER)


def indexed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with ``bar_idx``. The bars are written once: numbering reads them twice, and
    they are far fewer than the ticks they come from."""
    return index_bars(cut_lineage(daily_bars(spark, sf_dir)), timeframe_us=DAY_US)


# Events of one time are in order of their number.
EVENT_ORDER = ("ts", "event_id")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        utc("ts").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        "event_id",
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(event_ticks(spark, sf_dir), "1 hour", EVENT_ORDER)


def indexed_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(cut_lineage(hourly_bars(spark, sf_dir)), timeframe_us=HOUR_US)


def funding_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly average order price, stamped at the start of the month in epoch ms."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("month", utc("o_orderdate")).alias("m"))
        .agg(F.avg("o_totalprice").alias("fundingRate"))
        .select(F.unix_millis("m").alias("fundingTime"), "fundingRate")
    )


def open_interest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order count, stamped at the start of the week in epoch ms."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("week", utc("o_orderdate")).alias("w"))
        .agg(F.count(F.lit(1)).cast("double").alias("openInterest"))
        .select(F.unix_millis("w").alias("timestamp"), "openInterest")
    )


def lots_and_fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as lots of a supplier's stock; returned ones are fills of half as much again. Prices and half sizes are whole numbers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("portfolio"),
        F.concat(F.lit("s"), "l_suppkey").alias("symbol"),
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), cents).alias("id"),
        utc("l_shipdate").alias("ts"),
        price.alias("price"),
        "l_quantity", "l_linenumber", "l_returnflag",
    )
    lots = lines.where("l_returnflag <> 'R'").select(
        "portfolio", "symbol", F.col("id").alias("position_id"), F.col("ts").alias("entry_time"), F.col("price").alias("entry_price"),
        F.lit("BUY").alias("side"), F.col("l_quantity").alias("size"),
    )
    fills = lines.where("l_returnflag = 'R'").select(
        "portfolio", "symbol", F.col("id").alias("fill_id"), "ts", (F.col("price") + F.col("l_linenumber") * 7 - 20).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("TAKE_PROFIT")).otherwise(F.lit("STOP_LOSS")).alias("reason"), (F.col("l_quantity") * 1.5).alias("size"),
    )
    return lots, fills


def order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding halves as bid and ask volumes, best level first."""
    volumes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("snapshot_id"),
        F.slice(volumes, 1, 32).alias("bids"),
        F.slice(volumes, 33, 32).alias("asks"),
    )


BUYS = ("click", "purchase", "signup")


def trade_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of one market-wide symbol: ``BUYS`` are buys, all others sells."""
    return table(spark, sf_dir, "events").select(
        F.lit("MKT").alias("symbol"),
        utc("ts").alias("ts"),
        F.when(F.col("event_type").isin(*BUYS), F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        F.col("value").alias("size"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def local_exchange(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two views of holdings per (supplier, flag): what the book says and what the venue says."""
    held = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("symbol"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        )
        .agg(
            F.sum("l_quantity").alias("size"),
            F.max("l_extendedprice").alias("entry_price"),
            F.count(F.lit(1)).alias("fills"),
        )
    )
    local = held.where(F.col("fills") % 5 != 0).select("symbol", "side", "size", "entry_price")
    venue = held.where(F.col("fills") % 7 != 0).select(
        "symbol",
        "side",
        (F.col("size") + F.when(F.col("fills") % 3 == 0, 1.5).otherwise(0.00005)).alias("size"),
        "entry_price",
    )
    return local, venue
