"""Models in a stream: versions under one folder, jobs that retrain, scoring by the newest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.ml.retrain import retrain
from barflow.ml.signal import SignalModel
from barflow.operators.series import DAY_US, index_bars
from barflow.schemas import EVOLUTION
from barflow.sources.sinks import ordered
from barflow.streaming.batches import read_or_empty

VERSIONS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVOLUTION) + ", version bigint"


class ModelStore:
    """Models by version under ``path``.

    A version is published by its row of metrics, which is written after the model it points to; a reader sees the last
    published version or none, never half a model. A version that is published is not made again, so replayed batches
    neither repeat a training nor touch files that are being read.
    """

    def __init__(self, path: str):
        self.path = path

    def versions(self, spark: SparkSession) -> DataFrame:
        """One row of metrics per published version."""
        return read_or_empty(spark, f"{self.path}/evolution", VERSIONS)

    def has(self, spark: SparkSession, version: int) -> bool:
        return not self.versions(spark).where(F.col("version") == version).isEmpty()

    def publish(self, metrics: DataFrame, version: int) -> None:
        """``metrics``: one row of the evolution log, its ``model_path`` already written."""
        ordered(metrics, EVOLUTION).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/evolution/version={version}")

    def newest(self, spark: SparkSession) -> SignalModel | None:
        row = self.versions(spark).agg(F.max_by("model_path", "version").alias("path")).first()
        return SignalModel.load(spark, row.path) if row.path else None

    def retrain(self, version: int, indexed: DataFrame, trades: DataFrame | None, reason: str, **options) -> None:
        """Train, test, save and publish ``version``; nothing happens if it is published already."""
        if self.has(indexed.sparkSession, version):
            return
        _, metrics = retrain(indexed, trades, self.path, reason, tag=f"{version:012d}", **options)
        self.publish(metrics, version)


def on_trades(store: ModelStore, indexed: DataFrame, **options):
    """Job of a ``RetrainTrigger`` over closed trades: bars and trade features up to the milestone's trades."""
    return lambda trades, milestone: store.retrain(milestone, indexed, trades, f"{milestone} trades", **options)


def on_bars(store: ModelStore, timeframe_us: int = DAY_US, **options):
    """Job of a ``RetrainTrigger`` over closed bars: bar features only, of the bars so far."""

    def job(bars: DataFrame, milestone: int) -> None:
        numbered = index_bars(bars, timeframe_us=timeframe_us)
        store.retrain(milestone, numbered, None, f"{milestone} bars", timeframe_us=timeframe_us, **options)

    return job


class Scorer:
    """foreachBatch job: decisions of the model that is newest when the batch begins.

    Rows with a missing feature are left out, as are all rows while there is no model. Results lie under ``batch_id=<n>``.
    """

    SCHEMA = "symbol string, ts timestamp, signal string, p_tp double, p_sl double, p_time double, edge double"

    def __init__(self, store: ModelStore, path: str):
        self.store, self.path = store, path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        model = self.store.newest(batch.sparkSession)
        if model is not None:
            told = model.signals(batch.dropna("any", subset=[*model.features, "close", "atr"]))
            names = [part.split()[0] for part in self.SCHEMA.split(", ")]
            told.select(*names).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def results(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path, f"{self.SCHEMA}, batch_id bigint")
