"""Log tables: trades, snapshots, model evolution, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators.portfolio import latest_snapshot
from barflow.schemas import EVOLUTION, SNAPSHOTS, TELEMETRY_COLUMNS, TRADES


def ordered(df: DataFrame, schema: T.StructType, lead: tuple[str, ...] = ()) -> DataFrame:
    """Fixed columns and types, whatever the input holds; columns it lacks are NULL, as are values of another type."""
    have = set(df.columns)
    keep = [c for c in lead if c in have]
    typed = [(F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*keep, *typed)


def append_trades(trades: DataFrame, path: str) -> None:
    """Trade rows, one folder per exit day, so that readers of recent trades prune the rest.

    Rows of a day are brought together first, or every task would write a file per day; large days are split.
    """
    rows = ordered(trades, TRADES).withColumn("exit_date", F.to_date("exit_time")).hint("rebalance", "exit_date")
    rows.write.mode("append").partitionBy("exit_date").parquet(path)


def live_rows(rows: DataFrame, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    return latest_snapshot(rows, order=order)


def write_live_rows(rows: DataFrame, path: str) -> None:
    """One row per portfolio; each write replaces the rows of its own portfolios."""
    writer = ordered(live_rows(rows), SNAPSHOTS, ("portfolio",)).write.mode("overwrite")
    if "portfolio" in rows.columns:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("portfolio")
    writer.parquet(path)


def append_evolution(metrics: DataFrame, path: str) -> None:
    ordered(metrics, EVOLUTION).write.mode("append").parquet(path)


def telemetry_rows(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """Signals and closed trades in one event schema."""
    absent = F.lit(None).cast("double")
    said = signals.select(
        F.col("ts").alias("timestamp"),
        F.lit("signal").alias("type"),
        "symbol",
        F.round("price", 6).alias("price"),
        F.round("p_tp", 4).alias("p_tp"),
        F.round("p_sl", 4).alias("p_sl"),
        F.round("edge", 6).alias("edge"),
        F.round("tp_price", 6).alias("tp_price"),
        F.round("sl_price", 6).alias("sl_price"),
        "signal",
        absent.alias("pnl"),
    )
    done = trades.select(
        F.col("exit_time").alias("timestamp"),
        F.lit("trade").alias("type"),
        "symbol",
        F.round("entry_price", 6).alias("price"),
        *[absent.alias(c) for c in ("p_tp", "p_sl", "edge", "tp_price", "sl_price")],
        F.col("side").alias("signal"),
        F.col("pnl_usd").alias("pnl"),
    )
    return said.unionByName(done).select(*TELEMETRY_COLUMNS)
