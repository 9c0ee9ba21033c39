"""Standardisation whose statistics follow arriving data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.mergeable import merge_profiles, store_part, stored_parts


def learn(features: list, store: str):
    """A ``foreachBatch`` function that keeps each batch's moments below ``store``.

    A batch is stored under its number. One that is replayed after a failure replaces what
    it left before, so each batch counts once.
    """
    def step(batch: DataFrame, number: int) -> None:
        store_part(batch, features, store, number)

    return step


def learned_scaler(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """``(feature, mean, std)`` of all batches, or of those up to number ``version``; as ``fit_scaler`` gives."""
    return merge_profiles(stored_parts(spark, store, version)).select("feature", "mean", F.col("std_pop").alias("std"))


def run_learning(stream: DataFrame, features: list, store: str, progress: str) -> None:
    """Learn from everything that has arrived since the last run with the same ``progress`` folder."""
    query = (
        stream.writeStream.foreachBatch(learn(features, store)).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
