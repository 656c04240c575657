"""Milestone retraining with trade-log features."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import LAYOUT, LIVE, Layout
from barflow.functions.stats import accuracy
from barflow.ml.signal import SignalModel, forest, train
from barflow.operators.barriers import live_barrier
from barflow.operators.cv import chronological_split
from barflow.operators.features import feature_op
from barflow.operators.series import DAY_US, apply_local, index_bars
from barflow.operators.trades import last_bars, require_samples, trailing_trade_features
from barflow.schemas import EVOLUTION_COLUMNS, FEATURES, TRADE_FEATURES
from barflow.session import cut_lineage
from barflow.sources.sinks import append_evolution


def _names(trades: DataFrame | None) -> list[str]:
    return [*FEATURES] if trades is None else [*FEATURES, *TRADE_FEATURES]


def training_table(
    indexed: DataFrame, trades: DataFrame | None, expiry: str = "null", timeframe_us: int = DAY_US, layout: Layout = LAYOUT
) -> DataFrame:
    """Bar features, trade-log features (if there is a log) and labels without incomplete rows, numbered anew."""
    framed = apply_local(indexed, feature_op(), live_barrier(expiry=expiry), layout=layout)
    full = framed if trades is None else trailing_trade_features(framed, trades)
    clean = full.dropna("any", subset=[*_names(trades), "label"])
    return index_bars(clean.drop("bar_idx"), timeframe_us=timeframe_us, layout=layout)


def retrain(
    indexed: DataFrame,
    trades: DataFrame | None,
    path: str,
    reason: str = "100-trade milestone",
    estimator: Estimator | None = None,
    expiry: str = "null",
    trees: int = 300,
    timeframe_us: int = DAY_US,
    window: int | None = None,
    tag: str | None = None,
) -> tuple[SignalModel, DataFrame]:
    """Train on the first 80 % of every series of bars of ``timeframe_us``, test on the rest, save the model.

    Without a trade log (``trades`` is None) the bar features alone are used. ``window`` keeps the newest labelled rows of
    each symbol. The model's folder is named by ``tag``, else by the time. Returns the model and one row of metrics.
    """
    begun = time.time()
    names = _names(trades)
    full = training_table(indexed, trades, expiry, timeframe_us)
    if window:
        full = index_bars(cut_lineage(last_bars(full, window).drop("bar_idx")), timeframe_us=timeframe_us)
    table = cut_lineage(chronological_split(full, 0.8))
    n = require_samples(table, LIVE.min_samples)
    model = train(table.where("in_sample"), names, estimator=estimator or forest(trees))
    parts = model.score(table).groupBy("in_sample").agg(accuracy(F.col("prediction"), F.col("label")).alias("acc"))
    found = {row.in_sample: row.acc for row in parts.collect()}  # two rows
    target = f"{path}/model_{tag or datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%SZ')}"
    model.save(target)
    spark = indexed.sparkSession
    row = {
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "trigger": reason,
        "n_features": len(names),
        "n_samples": n,
        "n_estimators": trees if estimator is None else 0,
        "learning_rate": 0.0,
        "oos_accuracy": found.get(False),
        "in_sample_accuracy": found.get(True),
        "trade_count": 0 if trades is None else trades.count(),
        "duration_seconds": round(time.time() - begun, 3),
        "model_path": target,
        "notes": "features: " + ", ".join(names[len(FEATURES) :] or names),
    }
    schema = (
        "timestamp string, trigger string, n_features bigint, n_samples bigint, n_estimators bigint, learning_rate double, "
        "oos_accuracy double, in_sample_accuracy double, trade_count bigint, duration_seconds double, model_path string, notes string"
    )
    return model, spark.createDataFrame([tuple(row[c] for c in EVOLUTION_COLUMNS)], schema)


def maybe_retrain(
    indexed: DataFrame, trades: DataFrame, last_trigger: int, path: str, every: int = LIVE.retrain_every, **options
) -> tuple[SignalModel | None, int]:
    """Retrain if the number of closed trades has passed another multiple of ``every``."""
    n = trades.count()
    milestone = n // every * every
    if milestone <= last_trigger or milestone == 0:
        return None, last_trigger
    model, metrics = retrain(indexed, trades, path, f"Every-{every} trades", **options)
    append_evolution(metrics, f"{path}/evolution")
    return model, milestone
