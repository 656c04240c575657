"""Book against venue positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import RESEARCH


def compare_positions(local: DataFrame, venue: DataFrame, step_size: float = RESEARCH.step_size) -> DataFrame:
    """One row per (symbol, side) held on either side with ``status``: stale, resized, missing or ok."""
    held = local.withColumn("_here", F.lit(True)).alias("l")
    there = venue.select(
        "symbol", "side", F.col("size").alias("venue_size"), F.col("entry_price").alias("venue_entry"), F.lit(True).alias("_there")
    )
    joined = held.join(there, ["symbol", "side"], "full_outer")
    status = (
        F.when(F.col("_there").isNull(), "stale")
        .when(F.col("_here").isNull(), "missing")
        .when(F.abs(F.col("venue_size") - F.col("size")) > step_size, "resized")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_here", "_there")


def discrepancies(compared: DataFrame) -> DataFrame:
    """Rows that differ, with a readable message."""
    name = F.concat_ws(" ", "symbol", "side")
    message = (
        F.when(F.col("status") == "stale", F.concat(F.lit("Local position "), name, F.lit(" not found on exchange")))
        .when(
            F.col("status") == "resized",
            F.concat(
                F.lit("Size mismatch for "), F.col("symbol"), F.lit(": local="), F.col("size").cast("string"),
                F.lit(", exchange="), F.col("venue_size").cast("string"),
            ),
        )
        .when(F.col("status") == "missing", F.concat(F.lit("Exchange position "), name, F.lit(" missing locally")))
    )
    return compared.where(F.col("status") != "ok").select("symbol", "side", "status", message.alias("message"))


def reconciled(compared: DataFrame) -> DataFrame:
    """The corrected book: stale rows removed, sizes taken from the venue, missing rows added."""
    missing = F.col("status") == "missing"
    recovered = F.concat_ws("_", F.lit("recovered"), "symbol", "side")
    have = set(compared.columns)
    optional = {
        "tp_price": F.lit(0.0),
        "sl_price": F.lit(0.0),
        "position_id": recovered,
    }
    carried = [
        (F.when(missing, fresh).otherwise(F.col(c)) if c in have else F.when(missing, fresh)).alias(c)
        for c, fresh in optional.items()
    ]
    return compared.where(F.col("status") != "stale").select(
        "symbol",
        "side",
        F.when(F.col("status") == "ok", F.col("size")).otherwise(F.col("venue_size")).alias("size"),
        F.coalesce("entry_price", "venue_entry").alias("entry_price"),
        *carried,
    )
