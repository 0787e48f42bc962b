"""Small supervised and unsupervised models over vector columns, by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def two_clusters(df: DataFrame, id_col: str, vector: str, weight: str | None, seed: int) -> DataFrame:
    """id, cluster: weighted k-means with k = 2."""
    k = KMeans(k=2, seed=seed, featuresCol="features", predictionCol="cluster")
    if weight:
        k = k.setWeightCol(weight)
    data = _features(df, vector)
    return k.fit(data).transform(data).select(id_col, "cluster")


def logistic(df: DataFrame, id_col: str, vector: str, label: str, weight: str | None = None) -> DataFrame:
    """id, probability, prediction of a standardised logistic regression, balanced by a weight column if there is one."""
    data = _features(df, vector)
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(data).transform(data)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=50, regParam=0.01)
    if weight:
        model = model.setWeightCol(weight)
    out = model.fit(scaled).transform(scaled)
    return out.select(id_col, F.round(vector_to_array("probability")[1], 6).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


def forest(df: DataFrame, id_col: str, vector: str, label: str, seed: int) -> DataFrame:
    """id, prediction of a random forest for any number of classes."""
    data = _features(df, vector).withColumn(label, F.col(label).cast("double"))
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, maxDepth=5, seed=seed).fit(data)
    return model.transform(data).select(id_col, F.col("prediction").cast("int").alias("prediction"))
