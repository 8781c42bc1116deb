"""Clustering, projection and classification with the library's own distributed learners."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.fingerprints import N_BITS


def bits_vector(bits: Column, n_bits: int = N_BITS) -> Column:
    """0/1 values of a fingerprint as an array, built in the JVM."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda b: F.array_contains(bits, b).cast("double"))


def kmeans(df: DataFrame, features: Column, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """Adds ``cluster`` and ``d2``, the squared distance to its centre (Lloyd iterations; centres are as many as k)."""
    v = df.withColumn("_v", array_to_vector(features.cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_v", predictionCol="cluster").fit(v)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, _c array<double>")
    placed = model.transform(v).join(F.broadcast(centres), "cluster")
    d2 = F.aggregate(F.zip_with(vector_to_array("_v"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return placed.withColumn("d2", d2).drop("_v", "_c")


def project(df: DataFrame, features: Column, k: int = 2) -> DataFrame:
    """Adds ``x1..xk``: principal components, the documented stand-in for embeddings that Spark lacks."""
    v = df.withColumn("_v", array_to_vector(features.cast("array<double>")))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"x{i + 1}": F.col("_p")[i] for i in range(k)}).drop("_v", "_p")


def forest_scores(train: DataFrame, test: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 10, seed: int = 42, weight: str | None = None) -> DataFrame:
    """``test`` with ``y_prob`` of a random forest fitted on ``train``. Raises for a depth over 30, the library's limit."""
    if depth > 30:
        raise ValueError(f"forests are at most 30 deep, not {depth}")
    prepare = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    model = rf.fit(prepare.transform(train))
    return model.transform(prepare.transform(test)).withColumn("y_prob", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
