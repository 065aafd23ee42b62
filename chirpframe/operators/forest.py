"""Random forest on call features (``pyspark.ml``)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_forest(
    calls: DataFrame, num_classes: int, features: str = "features", label: str = "class_id",
    seed: int = 2001, trees: int = 100, depth: int = 10,
) -> RandomForestClassificationModel:
    """Action: fits on calls of known classes (0 ≤ class id < ``num_classes``)."""
    known = calls.where((F.col(label) >= 0) & (F.col(label) < num_classes)).select(
        array_to_vector(F.col(features).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y")
    )
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", predictionCol="_pred", probabilityCol="_prob",
        rawPredictionCol="_raw", numTrees=trees, maxDepth=depth, seed=seed,
    )
    return forest.fit(known)


def score_forest(calls: DataFrame, model: RandomForestClassificationModel, num_classes: int, features: str = "features") -> DataFrame:
    """Class probabilities and detection probability (sum of all but the last class)."""
    rows = calls.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    probs = vector_to_array("_prob")
    full = F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: F.coalesce(F.get(F.col("class_probs"), i), F.lit(0.0))
    )
    scored = model.transform(rows).withColumn("class_probs", probs).withColumn("class_probs", full)
    calls_prob = F.aggregate(F.slice("class_probs", 1, num_classes - 1), F.lit(0.0), lambda a, b: a + b)
    return scored.withColumn("det_prob", calls_prob).drop("_x", "_raw", "_prob", "_pred")
