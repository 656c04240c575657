"""Purged cross-validation and parameter grids with fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.stats import accuracy
from barflow.operators.cv import fold_role, summarize_folds
from barflow.operators.series import with_length
from barflow.session import cut_lineage

FitScore = Callable[[DataFrame, DataFrame, dict], DataFrame]


def evaluate_folds(
    rows: DataFrame,
    fit_score: FitScore,
    n_splits: int = 5,
    embargo: int = 0,
    params: dict | None = None,
    label: str = "label",
    metric: Callable[[Column, Column], Column] = accuracy,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """``(fold, score)``. ``fit_score(train, test, params)`` returns the test rows + ``prediction``.

    The driver loops over folds only; fitting and scoring are Spark jobs on filtered rows. Rows that carry ``n_bars`` are
    used as they are, others are written once with their series' length.
    """
    if n_splits < 2 or embargo < 0:
        raise ValueError("n_splits must be >= 2 and embargo >= 0")
    sized = rows if "n_bars" in rows.columns else with_lengths(rows, keys)
    scores = []
    for fold in range(n_splits):
        role = fold_role(F.lit(fold), n_splits, embargo)
        train, test = (sized.where(role == name).drop("n_bars") for name in ("train", "test"))
        scored = fit_score(train, test, params or {})
        score = scored.agg(metric(F.col("prediction"), F.col(label)).alias("score"))
        scores.append(score.select(F.lit(fold).alias("fold"), "score"))
    return reduce(DataFrame.unionByName, scores)


def with_lengths(rows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return cut_lineage(with_length(rows, list(keys)))


def nested_purged_cv(rows: DataFrame, fit_score: FitScore, n_splits: int = 5, embargo: int = 0, **options) -> DataFrame:
    """One row ``mean_score, std_score, fold_0 ..``; tuning inside the folds is up to ``fit_score``."""
    scores = evaluate_folds(rows, fit_score, n_splits, embargo, **options)
    return summarize_folds(scores.withColumn("run", F.lit(0)), ["run"], n_splits).drop("run")


def parameter_grid(
    rows: DataFrame, grid: dict[str, Sequence], fit_score: FitScore, n_splits: int = 5, embargo: int = 0, **options
) -> DataFrame:
    """One summary row per combination; parameters are columns."""
    names = list(grid)
    rows = with_lengths(rows, options.get("keys", ("symbol",)))
    results = []
    for combo in product(*grid.values()):
        params = dict(zip(names, combo))
        scores = evaluate_folds(rows, fit_score, n_splits, embargo, params, **options)
        results.append(scores.select(*[F.lit(v).alias(n) for n, v in params.items()], "fold", "score"))
    return summarize_folds(reduce(DataFrame.unionByName, results), names, n_splits)
