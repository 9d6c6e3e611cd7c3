"""Fitted models over feature arrays, by the library that runs where the data is."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(rows: DataFrame, features: str, *others: str) -> DataFrame:
    return rows.select(*others, array_to_vector(F.col(features).cast("array<double>")).alias("features"))


def linear_regression(rows: DataFrame, key: str, features: str, label: str, ridge: float = 0.0) -> DataFrame:
    """(key, prediction)."""
    from pyspark.ml.regression import LinearRegression

    data = _features(rows, features, key, label)
    return LinearRegression(labelCol=label, regParam=ridge, elasticNetParam=0.0, solver="normal").fit(data).transform(data).select(key, "prediction")


def classify(rows: DataFrame, key: str, features: str, label: str, kind: str = "logistic") -> DataFrame:
    """(key, prediction, probabilities) of a model fitted on rows with a label and applied to all."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier

    model = {
        "logistic": lambda: LogisticRegression(labelCol=label), "bayes": lambda: NaiveBayes(labelCol=label, modelType="gaussian"),
        "forest": lambda: RandomForestClassifier(labelCol=label, seed=7), "boosted": lambda: GBTClassifier(labelCol=label, seed=7),
    }[kind]()
    data = _features(rows, features, key, label)
    return model.fit(data.where(F.col(label).isNotNull())).transform(data).select(key, "prediction", vector_to_array("probability").alias("probabilities"))


def mixture(rows: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, cluster) of a Gaussian mixture, seeded."""
    from pyspark.ml.clustering import GaussianMixture

    data = _features(rows, features, key)
    return GaussianMixture(k=k, seed=7).fit(data).transform(data).select(key, F.col("prediction").cast("long").alias("cluster"))


def principal_components(rows: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, scores)."""
    from pyspark.ml.feature import PCA

    data = _features(rows, features, key)
    return PCA(k=k, inputCol="features", outputCol="scores").fit(data).transform(data).select(key, vector_to_array("scores").alias("scores"))


def topics(docs: DataFrame, k: int = 5, words: int = 2000) -> DataFrame:
    """(topic, terms): the ten likeliest words of each topic of a latent Dirichlet model over the most frequent words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    split = docs.select(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: t != "").alias("tokens")).where("tokens IS NOT NULL")
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=words).fit(split)
    found = LDA(k=k, maxIter=10, seed=7).fit(counts.transform(split)).describeTopics(10)
    names = F.array(*[F.lit(w) for w in counts.vocabulary])
    return found.select("topic", F.array_join(F.transform("termIndices", lambda i: F.get(names, i)), " ").alias("terms"))
