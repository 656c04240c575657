"""Joins of many rows to one row per key where a few keys may own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, or more than a hundred-thousandth of all rows, is joined in several parts.
PART_ROWS = 1_000
PARTS = 100_000


def hot_parts(counts: DataFrame, keys: Sequence[str], rows: str = "m") -> DataFrame:
    """(hot, parts): hash of the keys that need several parts. ``counts`` has ``keys`` and their number of rows.

    At most ``PARTS`` keys can hold more than a ``PARTS``-th of all rows, so the result may be broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    bound = max(PART_ROWS, int(total) // PARTS)
    return counts.filter(F.col(rows) > bound).groupBy(F.xxhash64(*keys).alias("hot")).agg(F.ceil(F.max(rows) / bound).alias("parts"))


def join_parts(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key``; rows of a hot key are dealt over its parts and its one row is copied to each."""
    name, found = F.xxhash64(*keys), F.broadcast(hot)
    dealt = rows.join(found, name == F.col("hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0))).drop("hot", "parts")
    copied = per_key.join(found, name == F.col("hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("hot", "parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
