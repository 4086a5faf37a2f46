"""Boosted trees on region vectors, their scores, and the roll-up of their importances."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(samples: DataFrame, vector: str = "vector", label: str = "label", depth: int = 3, step: float = 0.2, rounds: int = 100, seed: int = 6) -> GBTClassificationModel:
    """Boosted trees for a 0/1 label."""
    data = samples.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return GBTClassifier(maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed).fit(data)


def score(model: GBTClassificationModel, rows: DataFrame, vector: str = "vector", out: str = "margin") -> DataFrame:
    """Add the margin: half the log odds; above 0 means positive."""
    done = model.transform(rows.withColumn("features", array_to_vector(vector)))
    return done.withColumn(out, vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: GBTClassificationModel, names: list[str]) -> list[tuple[str, float]]:
    """(feature, gain) of every vector position that the trees use."""
    v = model.featureImportances
    return [(names[int(i)], float(x)) for i, x in zip(v.indices, v.values, strict=True)]


def roll_up(gains: DataFrame, name: str = "name", gain: str = "gain", top: int = 5) -> DataFrame:
    """(feature, total): gains summed over the thresholds of a feature (``feature*threshold``), the ``top`` ones."""
    return gains.groupBy(F.substring_index(name, "*", 1).alias("feature")).agg(F.sum(gain).alias("total")).orderBy(F.desc("total"), "feature").limit(top)
