"""Time-series cross-validation as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.stats import accuracy
from barflow.operators.series import with_length


def purged_folds(indexed: DataFrame, n_splits: int = 5, embargo: int = 0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, bar_idx, fold, role)`` with role test, embargo or train for every row and fold.

    Test blocks are contiguous, the last takes the remainder; ``embargo`` bars after a block are
    kept out of training. Folds multiply rows in place: no shuffle beyond the length lookup.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    if embargo < 0:
        raise ValueError("embargo must be >= 0")
    sized = with_length(indexed.select(*keys, "bar_idx"), keys)
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    role = fold_role(F.col("fold"), n_splits, embargo).alias("role")
    return sized.select(*keys, "bar_idx", "n_bars", folds).select(*keys, "bar_idx", "fold", role)


def fold_role(fold: Column, n_splits: int, embargo: int = 0) -> Column:
    """Role of a row in a fold: test, embargo or train; needs ``bar_idx`` and ``n_bars``."""
    block = F.floor(F.col("n_bars") / n_splits)
    begin = fold * block
    stop = F.when(fold == n_splits - 1, F.col("n_bars")).otherwise(begin + block)
    return (
        F.when((F.col("bar_idx") >= begin) & (F.col("bar_idx") < stop), "test")
        .when((F.col("bar_idx") >= stop) & (F.col("bar_idx") < stop + embargo), "embargo")
        .otherwise("train")
    )


def fold_of_row(n_splits: int) -> Column:
    """The only fold in which a row is tested; needs ``bar_idx`` and ``n_bars``."""
    block = F.floor(F.col("n_bars") / n_splits)
    return F.least(F.coalesce(F.floor(F.try_divide(F.col("bar_idx"), block)), F.lit(n_splits - 1)), F.lit(n_splits - 1)).cast("int")


def walk_forward(
    indexed: DataFrame,
    train_window: int,
    test_window: int,
    step: int | None = None,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """``(keys, bar_idx, fold, role)`` of rolling splits that fit into the series.

    Each row lists the folds that contain it, at most (train + test) / step + 1 of them.
    """
    step = step or test_window
    span = train_window + test_window
    sized = with_length(indexed.select(*keys, "bar_idx"), keys).where(F.col("n_bars") >= span)
    first = F.greatest(F.ceil((F.col("bar_idx") - span + 1) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("bar_idx") / step), F.floor((F.col("n_bars") - span) / step)).cast("int")
    listed = sized.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    role = F.when(F.col("bar_idx") < F.col("fold") * step + train_window, "train").otherwise("test")
    return listed.select(*keys, "bar_idx", "fold", role.alias("role"))


def grid_rows(grid: dict[str, Sequence]) -> Column:
    """Every combination of a parameter grid as an array of structs. The grid is caller input."""
    names = list(grid)
    combos = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, combo)]) for combo in product(*grid.values())]
    return F.array(*combos)


def rule_grid(
    labelled: DataFrame,
    grid: dict[str, Sequence],
    predict: Column,
    n_splits: int = 5,
    label: str = "label",
    metric: Callable[[Column, Column], Column] = accuracy,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Score of a rule for every parameter combination and fold, summarized per combination.

    ``labelled`` has ``bar_idx``; ``predict`` may use its columns and the parameters. A rule has
    nothing to fit, so each row is scored once per combination, in its test fold; combinations
    multiply rows in place and are reduced before any shuffle.
    """
    names = list(grid)
    sized = with_length(labelled, keys).withColumn("fold", fold_of_row(n_splits))
    scored = (
        sized.select("*", F.explode(grid_rows(grid)).alias("_g"))
        .select(*sized.columns, "_g.*")
        .groupBy(*keys, *names, "fold")
        .agg(metric(predict, F.col(label)).alias("score"))
    )
    return summarize_folds(scored, [*keys, *names], n_splits)


def summarize_folds(scores: DataFrame, keys: Sequence[str], n_splits: int) -> DataFrame:
    """``mean_score, std_score`` (population) and ``fold_0 ..`` from ``(keys, fold, score)``."""
    folds = [F.max(F.when(F.col("fold") == i, F.col("score"))).alias(f"fold_{i}") for i in range(n_splits)]
    return scores.groupBy(*keys).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), *folds
    )


def chronological_split(indexed: DataFrame, share: float = 0.8, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds ``in_sample``: the first ``share`` of each series trains, the rest tests."""
    sized = with_length(indexed, keys)
    return sized.withColumn("in_sample", F.col("bar_idx") < F.floor(share * F.col("n_bars"))).drop("n_bars")
