"""Meta-labelling: a second model learns when the first one is right."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.signals import gated_bet, meta_label, pick_direction, side_probabilities
from barflow.ml.signal import forest
from barflow.session import cut_lineage

# Active labels -1, +1 are classes 0, 1 of the primary model.


def _direction(threshold: float) -> Column:
    shares = vector_to_array("probability")
    classes = [(-1, F.get(shares, F.lit(0))), (1, F.get(shares, F.lit(1)))]
    return pick_direction(classes, threshold)


@dataclass
class MetaModel:
    primary: PipelineModel
    meta: PipelineModel | None
    constant: float | None
    threshold: float = 0.5

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``direction``, ``p_correct``, ``p_down`` and ``p_up``."""
        scratch = ("_x", "rawPrediction", "probability", "prediction")
        out = self.primary.transform(rows).withColumn("direction", _direction(self.threshold)).drop(*scratch)
        if self.meta is None:
            out = out.withColumn("p_correct", F.lit(self.constant))
        else:
            out = self.meta.transform(out)
            out = out.withColumn("p_correct", F.get(vector_to_array("probability"), F.lit(1))).drop(*scratch)
        down, up = side_probabilities(F.col("direction"), F.col("p_correct"))
        return out.withColumns({"p_down": down, "p_up": up})

    def predict(self, rows: DataFrame, bet_threshold: float = 0.5) -> DataFrame:
        return self.score(rows).withColumn("bet", gated_bet(F.col("p_down"), F.col("p_up"), bet_threshold))


def fit_meta(
    rows: DataFrame,
    features: Sequence[str],
    label: str = "label",
    primary: Estimator | None = None,
    meta: Estimator | None = None,
    threshold: float = 0.5,
) -> MetaModel:
    """Primary model on active rows, then a model of whether its direction was right.

    Where the direction is always right or always wrong, that constant replaces the second model.
    """
    names = list(features)
    active = rows.dropna("any", subset=[*names, label]).where(F.col(label) != 0)
    active = cut_lineage(active.withColumn("_y", (F.col(label) > 0).cast("double")))
    if active.isEmpty():
        raise ValueError("no active labels to fit the primary model")
    assemble = VectorAssembler(inputCols=names, outputCol="_x")
    first = Pipeline(stages=[assemble, primary or forest(100)]).fit(active)
    judged = first.transform(active).withColumn("_right", meta_label(_direction(threshold), F.col(label)))
    judged = cut_lineage(judged.select(*names, F.col("_right").cast("double").alias("_y")))
    low, high = judged.agg(F.min("_y"), F.max("_y")).first()
    if low == high:
        return MetaModel(first, None, float(low), threshold)
    second = Pipeline(stages=[assemble, meta or forest(100)]).fit(judged)
    return MetaModel(first, second, None, threshold)
