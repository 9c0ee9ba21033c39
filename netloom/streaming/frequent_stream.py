"""The most frequent values of everything that has arrived on a stream."""

from pyspark.sql import DataFrame

from netloom.operators.frequent import TRACKED, store_summary


def summarise_batches(column: str, store: str, tracked: int = TRACKED):
    """A ``foreachBatch`` function that keeps each batch's summary below ``store``.

    A batch that is replayed after a failure replaces what it left, so it counts once.
    """
    def step(batch: DataFrame, number: int) -> None:
        store_summary(batch, column, store, number, tracked)

    return step


def run_summaries(stream: DataFrame, column: str, store: str, progress: str) -> None:
    """Summarise everything that has arrived since the last run with the same ``progress`` folder."""
    query = (
        stream.writeStream.foreachBatch(summarise_batches(column, store)).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
