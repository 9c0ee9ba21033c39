"""Documented-only: a binary or multi-class classifier on the engineered table.

A missing feature is an error, in training and in scoring: no row is left out silently.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.schema import LABEL


def _assembled(df: DataFrame, features: list) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_vector", handleInvalid="error").transform(df)


def train(df: DataFrame, features: list, label_col: str = LABEL, rounds: int = 20, split_col=None):
    """Fit a logistic model on the rows of the split ``train`` (or on all rows)."""
    rows = df.filter(F.col(split_col) == "train") if split_col else df
    rows = _assembled(rows.withColumn(label_col, F.col(label_col).cast("double")), features)
    return LogisticRegression(featuresCol="_vector", labelCol=label_col, maxIter=rounds).fit(rows)


def score(df: DataFrame, model, features: list) -> DataFrame:
    """Adds ``scores`` (probability per class) and ``predicted``."""
    rows = model.transform(_assembled(df, features))
    return rows.withColumns(
        {"scores": vector_to_array("probability"), "predicted": F.col("prediction").cast("bigint")}
    ).drop("_vector", "rawPrediction", "probability", "prediction")
