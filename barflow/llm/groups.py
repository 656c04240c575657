"""One row of each group of rows that belong together, all other rows untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.hot_keys import hot_parts, join_parts


def keep_one(docs: DataFrame, key: Column | None, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that lose against another row of their group.

    ``key`` gives a row's key (None: ``docs`` has it as ``_key``). ``groups(_key, _group, _best, m)`` has one row per key
    whose group has several rows: the group, the doc_id of the row that stays, null only if all are, and the rows of the key. Of
    several rows with that doc_id the one with the smallest hash of all columns stays, of fully equal rows one. Rows decide
    for themselves, so another row of the same doc_id is not touched.
    """
    columns = [c for c in docs.columns if c != "_key"]
    rows = docs if key is None else docs.withColumn("_key", key)
    joined = join_parts(rows, groups.drop("m"), ["_key"], hot_parts(groups, ["_key"]), "left")
    single = joined.filter(F.col("_group").isNull()).select(columns)
    best = joined.filter(F.col("_group").isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col("_best")))
    one = best.groupBy("_group").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return single.unionByName(one)
