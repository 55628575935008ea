"""Learners of Spark ML on the same features: multinomial logistic regression and linear support vector machines."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def count_vectors(texts: DataFrame, size: int = 4000) -> DataFrame:
    """``(doc_id, label, features)`` of ``texts(doc_id, text, label)``."""
    words = texts.select("doc_id", F.col("label").cast("double").alias("label"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    return CountVectorizer(inputCol="words", outputCol="features", vocabSize=size).fit(words).transform(words).drop("words")


def logistic(rows: DataFrame, *, penalty: float = 1.0, iterations: int = 20):
    """Softmax regression without a bias; its optimum is that of the ascent without the bias column."""
    return LogisticRegression(family="multinomial", fitIntercept=False, standardization=False, elasticNetParam=0.0, regParam=penalty / max(rows.count(), 1), maxIter=iterations).fit(rows)


def linear_svc(rows: DataFrame, *, c: float = 1.0, iterations: int = 20):
    """Binary linear SVM with hinge loss and an L2 penalty of 1 / (c * rows)."""
    return LinearSVC(regParam=1.0 / (c * max(rows.count(), 1)), maxIter=iterations).fit(rows)


def linear_svc_classes(rows: DataFrame, *, c: float = 1.0, iterations: int = 20):
    """One linear SVM a class, the largest margin deciding."""
    return OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * max(rows.count(), 1)), maxIter=iterations)).fit(rows)
