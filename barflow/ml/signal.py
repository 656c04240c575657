"""Signal classifier on MLlib with class probabilities by label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.signals import signal_columns
from barflow.schemas import FEATURES

# Labels -1, 0, +1 are classes 0, 1, 2.
SHIFT = 1


def forest(trees: int = 300, min_leaf: int = 10, seed: int = 42, **options) -> Estimator:
    return RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=trees, minInstancesPerNode=min_leaf, seed=seed, **options
    )


def boosted(trees: int = 300, rate: float = 0.05, depth: int = 5, seed: int = 42) -> Estimator:
    """Boosted trees are binary in MLlib: one model per class against the rest."""
    inner = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=inner, featuresCol="_x", labelCol="_y", rawPredictionCol="rawPrediction", parallelism=3)


def bayes() -> Estimator:
    """Gaussian naive Bayes: counts, means and variances per class, all from one aggregate."""
    return NaiveBayes(featuresCol="_x", labelCol="_y", modelType="gaussian")


@dataclass
class SignalModel:
    """A fitted pipeline with the features and the number of rows it was trained on."""

    pipeline: PipelineModel
    features: list[str]
    trained_rows: int

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction`` (a label), ``p_tp`` and ``p_sl``; also works on a stream."""
        scored = self.pipeline.transform(rows)
        if "probability" in scored.columns:
            shares = vector_to_array("probability")
        else:
            margins = vector_to_array("rawPrediction")
            odds = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
            total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
            shares = F.transform(odds, lambda o: o / total)
        scored = scored.withColumn("_p", shares)
        return scored.withColumns(
            {
                "p_tp": F.coalesce(F.get("_p", F.lit(1 + SHIFT)), F.lit(0.0)),
                "p_sl": F.coalesce(F.get("_p", F.lit(-1 + SHIFT)), F.lit(0.0)),
                "prediction": (F.col("prediction") - SHIFT).cast("int"),
            }
        ).drop("_p", "_x", "rawPrediction", "probability")

    def signals(self, rows: DataFrame, price: str = "close") -> DataFrame:
        """Scored rows -> BUY / SIT_OUT decisions (T4 when ``rows`` is a stream)."""
        scored = self.score(rows)
        columns = signal_columns(
            F.col(price), F.col("atr"), F.col("p_tp"), F.col("p_sl"), F.lit(self.trained_rows)
        )
        return scored.select("symbol", "ts", *[c.alias(n) for n, c in columns.items()])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        meta = spark.createDataFrame([(self.features, self.trained_rows)], "features array<string>, trained_rows bigint")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SignalModel:
        meta = spark.read.schema("features array<string>, trained_rows bigint").json(f"{path}/meta").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), list(meta.features), meta.trained_rows)


def train(
    rows: DataFrame, features: Sequence[str] = tuple(FEATURES), label: str = "label", estimator: Estimator | None = None
) -> SignalModel:
    """Fit on rows whose features and label are known. The rows of all symbols pool."""
    names = list(features)
    data = rows.dropna("any", subset=[*names, label]).withColumn("_y", (F.col(label) + SHIFT).cast("double"))
    data = data.select(*names, "_y").persist()
    try:
        count = data.count()
        if count == 0:
            raise ValueError("no labelled rows to train on")
        stages = [VectorAssembler(inputCols=names, outputCol="_x"), estimator or forest()]
        fitted = Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()
    return SignalModel(fitted, names, count)


