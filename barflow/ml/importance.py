"""Permutation importance and feature pruning."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.ml.signal import SignalModel, forest, train
from barflow.operators.series import Measure, depth_chunks, exclusive_scan
from barflow.session import cut_lineage

#: Fixed values of the permutation: a prime below 2**31, multipliers of its keys, rounds, and most steps of a walk.
PRIME, KEYS, ROUNDS, WALK = 2_147_483_629, (1_000_003, 8_191, 131, 31), 6, 16


def numbered(rows: DataFrame, order: Sequence[str], name: str = "_id", layout: Layout = LAYOUT) -> DataFrame:
    """``rows`` with their 0-based place along ``order`` (unique): place in a chunk and the rows of earlier chunks."""
    dealt = depth_chunks(rows.withColumn("_all", F.lit(0)), ["_all"], order, layout=layout)
    sizes = dealt.groupBy("_all", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    before = exclusive_scan(sizes, ["_all"], "_chunk", [Measure("n", "sum")], layout)
    place = F.row_number().over(Window.partitionBy("_all", "_chunk").orderBy(*order)) - 1
    joined = dealt.withColumn("_place", place).join(before, ["_all", "_chunk"], "left")
    return joined.withColumn(name, F.coalesce("c_n", F.lit(0)) + F.col("_place")).drop("_all", "_chunk", "_place", "c_n")


def permuted(x: Column, n: int, seed: int, *keys: Column) -> Column:
    """Image of ``x`` under a permutation of 0 .. n - 1 that the seed and two small keys choose; no row has to know another.

    A Feistel network on pairs (l, r) with l < a and r < b, a * b just above n: each round adds a function of one half to the
    other, which can be undone. A number that leaves the range walks on along its cycle until it is back: for n up to 256 within
    ``WALK`` steps, beyond but for a chance of n**(-WALK / 2).
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    base = F.lit(seed * KEYS[0]).cast("bigint") + keys[0].cast("bigint") * KEYS[1] + keys[1].cast("bigint") * KEYS[2]

    def turned(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        k = (base + turn.cast("bigint") * KEYS[3]) % PRIME
        half = F.when(even, pair["r"]).otherwise(pair["l"])
        # one name for what is used twice
        t = F.transform(F.array((half * ((k * 48_271) % PRIME) + (k * 40_692) % PRIME) % PRIME), lambda t: (t * (t + k)) % PRIME)[0]
        return F.struct(F.when(even, (pair["l"] + t) % a).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise((pair["r"] + t) % b).alias("r"))

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turned, lambda p: p["l"] * b + p["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK - 1)), once(x.cast("bigint")), lambda at, _: F.when(at < n, at).otherwise(once(at)))
    return walked.cast("bigint")


def permutation_importance(
    model: SignalModel,
    rows: DataFrame,
    label: str = "label",
    n_repeats: int = 5,
    seed: int = 42,
    row_key: Sequence[str] = ("symbol", "ts"),
) -> DataFrame:
    """``(feature, importance)``: accuracy lost when one feature is shuffled, averaged over repeats.

    All (feature, repeat) variants are scored in one pass. The row that gives its value is computed from the row's number, so
    a shuffle is an equality join with the table itself.
    """
    names = model.features
    base = rows.select(*row_key, *names, label).dropna("any", subset=[*names, label])
    base = cut_lineage(numbered(base, row_key))
    n = base.count()
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    baseline = model.score(base).agg(right.alias("_base"))

    variants = F.explode(
        F.array(*[F.struct(F.lit(i).alias("f"), F.lit(rep).alias("rep")) for i in range(len(names)) for rep in range(n_repeats)])
    )
    spread = base.select("*", variants.alias("_v")).select(*base.columns, "_v.f", "_v.rep")
    spread = spread.withColumn("_donor", permuted(F.col("_id"), n, seed, F.col("f"), F.col("rep")))
    donors = base.select(F.col("_id").alias("_donor"), F.array(*names).alias("_values"))
    shuffled = spread.join(donors, "_donor").withColumns(
        {name: F.when(F.col("f") == i, F.get("_values", F.lit(i))).otherwise(F.col(name)) for i, name in enumerate(names)}
    )
    lost = model.score(shuffled).groupBy("f", "rep").agg(right.alias("_acc"))
    label_name = F.get(F.array(*[F.lit(n) for n in names]), F.col("f")).alias("feature")
    return (
        lost.crossJoin(F.broadcast(baseline))  # one row: the accuracy of the untouched table
        .groupBy("f")
        .agg(F.avg(F.col("_base") - F.col("_acc")).alias("importance"))
        .select(label_name, "importance")
    )


def keep_features(importance: DataFrame, keep: int | None = None, min_importance: float | None = None) -> list[str]:
    """Names by falling importance; ``keep`` wins over ``min_importance``. One row per feature."""
    if keep is None and min_importance is None:
        raise ValueError("give keep or min_importance")
    ranked = importance.orderBy(F.desc("importance"), "feature")
    ranked = ranked.limit(keep) if keep is not None else ranked.where(F.col("importance") >= min_importance)
    return [row.feature for row in ranked.select("feature").collect()]


def prune_features(
    rows: DataFrame,
    features: Sequence[str],
    make_estimator: Callable[[], Estimator],
    keep: int | None = None,
    min_importance: float | None = None,
    n_repeats: int = 5,
    seed: int = 42,
    label: str = "label",
) -> tuple[list[str], DataFrame]:
    if keep is None and min_importance is None:
        raise ValueError("give keep or min_importance")
    model = train(rows, features, label, make_estimator())
    importance = cut_lineage(permutation_importance(model, rows, label, n_repeats, seed))
    return keep_features(importance, keep, min_importance), importance


def select_features(
    rows: DataFrame, features: Sequence[str], keep_share: float = 0.5, seed: int = 42, trees: int = 50, label: str = "label"
) -> list[str]:
    """Top share of the features by the importance a forest gives them, one at least."""
    count = max(1, math.ceil(keep_share * len(features)))
    kept, _ = prune_features(
        rows, features, lambda: forest(trees, min_leaf=1, seed=seed), keep=count, n_repeats=3, seed=seed, label=label
    )
    return kept
