"""Bar, funding and open-interest scans (S1-S5) and the clean-up they share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.schemas import OHLCV


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value downstream; NaN from other tools is turned into it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def scan_ohlcv(raw: DataFrame, ms: str = "ms") -> DataFrame:
    """Exchange rows ``(symbol, epoch ms, o, h, l, c, v)`` -> typed bars, incomplete rows dropped."""
    typed = raw.select(
        "symbol",
        F.timestamp_millis(F.col(ms).cast("bigint")).alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV],
    )
    return nan_to_null(typed).dropna("any", subset=OHLCV)


def require_rows(df: DataFrame, what: str = "bars") -> DataFrame:
    """Empty input is an error. Stops at the first row found."""
    if df.isEmpty():
        raise ValueError(f"no {what} to read")
    return df


def normalize_columns(df: DataFrame, wanted: Sequence[str] = tuple(OHLCV)) -> DataFrame:
    """Case-insensitive pick of the OHLCV columns from a provider frame.

    A two-level header arrives as struct columns (``Close.AAA``); its first level is used, as the
    frame holds one instrument. Other columns are kept in front under lower-case names only when
    they are ``symbol`` or ``ts``.
    """
    named: dict[str, Column] = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            column = column.getField(field.dataType.fields[0].name)
        named[field.name.lower()] = column
    missing = [c for c in wanted if c not in named]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    lead = [named[c].alias(c) for c in ("symbol", "ts") if c in named]
    picked = df.select(*lead, *[named[c].cast("double").alias(c) for c in wanted])
    return nan_to_null(picked).dropna("any", subset=list(wanted))


def ticks_to_bars(
    ticks: DataFrame,
    timeframe: str,
    order: Sequence[str] = ("ts",),
    price: str = "price",
    size: str = "size",
) -> DataFrame:
    """Bars per (symbol, interval); intervals without a tick give no row.

    ``order`` must be unique inside an interval; first and last price follow it. All five
    aggregates combine on the map side, so a hot symbol costs one partial row per task. A single
    number or time as order keeps the aggregation hash-based; several columns make Spark sort.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    return (
        ticks.groupBy("symbol", F.window("ts", timeframe).alias("_w"))
        .agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.sum(size).cast("double").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), *OHLCV)
    )


def scan_funding(raw: DataFrame) -> DataFrame:
    """Accepts ``timestamp`` or ``fundingTime`` (epoch ms) and either rate spelling."""
    times = [c for c in ("timestamp", "fundingTime") if c in raw.columns]
    rates = [c for c in ("funding_rate", "fundingRate") if c in raw.columns]
    if not times or not rates:
        raise ValueError("funding needs a time and a rate column")
    return raw.select(
        *[c for c in ("symbol",) if c in raw.columns],
        F.timestamp_millis(F.coalesce(*[F.col(c) for c in times]).cast("bigint")).alias("ts"),
        F.coalesce(*[F.col(c) for c in rates]).cast("double").alias("funding_rate"),
    )


def scan_open_interest(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[c for c in ("symbol",) if c in raw.columns],
        F.timestamp_millis(F.col("timestamp").cast("bigint")).alias("ts"),
        F.col("openInterest").cast("double").alias("open_interest"),
    )
