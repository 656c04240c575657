"""Bar snapshots with a freshness bound and nested portfolio documents."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.config import LIVE
from barflow.schemas import PORTFOLIO


def write_snapshot(df: DataFrame, path: str) -> None:
    """CSV or parquet by the ending of ``path``; a folder of part files either way."""
    writer = df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, max_age_seconds: float | None = None
) -> DataFrame | None:
    """The table at ``path``; None if it is missing or, with a bound, not fresh enough.

    Fresh or stale is decided once for the whole snapshot, by its newest part file; an age equal to
    the bound is stale. In CSV, columns named ``timestamp`` or containing ``time`` become UTC
    timestamps; without a schema other columns are read as text or as inferred numbers.
    """
    is_csv = path.endswith(".csv")
    reader = spark.read.format("csv" if is_csv else "parquet")
    if is_csv:
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    try:
        if max_age_seconds is not None:
            written = spark.read.format("binaryFile").load(path).agg(F.unix_micros(F.max("modificationTime"))).first()[0]
            if written is None or time.time() - written / 1e6 >= max_age_seconds:
                return None
        df = reader.load(path)
    except Exception as exc:
        if any(word in str(exc) for word in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            return None
        raise
    if is_csv:
        timed = [f.name for f in df.schema.fields if "time" in f.name.lower() and not isinstance(f.dataType, T.TimestampType)]
        df = df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in timed})
    return df


def read_state(
    spark: SparkSession, path: str, starting_cash: float = LIVE.starting_cash, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(accounts, positions) from portfolio documents: one JSON object per file, or per line without ``multi_line``.

    The fixed schema drops unknown keys. Cash defaults to the starting cash; positions without
    a remaining size keep their full size.
    """
    raw = spark.read.schema(PORTFOLIO).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    documents = raw.withColumn("source", F.input_file_name())
    start = F.coalesce("starting_cash_usd", F.lit(starting_cash))
    accounts = documents.select(
        "source",
        start.alias("starting_cash_usd"),
        F.coalesce("cash_usd", start).alias("cash_usd"),
        F.coalesce(F.size("positions"), F.lit(0)).alias("open_positions"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"),
        F.coalesce("winning_trades", F.lit(0)).alias("winning_trades"),
        F.coalesce("daily_pnl", F.lit(0.0)).alias("daily_pnl"),
        F.coalesce("daily_start_equity", start).alias("daily_start_equity"),
        "last_timestamp",
    )
    trades = F.coalesce("total_trades", F.lit(0)).alias("total_trades")
    positions = documents.select("source", trades, F.explode("positions").alias("p")).select("source", "total_trades", "p.*")
    whole = F.when(F.coalesce("remaining_size", F.lit(0.0)) == 0, F.col("size")).otherwise(F.col("remaining_size"))
    positions = positions.withColumns(
        {
            "remaining_size": whole,
            "bars_held": F.coalesce("bars_held", F.lit(0)),
            "entry_time": F.try_to_timestamp("entry_time"),
        }
    )
    return accounts, positions
