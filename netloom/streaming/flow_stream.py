"""Flow features, inter-arrival variation and byte entropy on streams."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.features import add_engineered_features, let
from netloom.functions.instants import micros
from netloom.operators.scale import apply_scaler
from netloom.operators.series import ZERO_GAP, entropy_of_counts, partial_byte_counts
from netloom.plans.sizing import scratch_path


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_trigger=None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_features(flows: DataFrame, stats: DataFrame = None, partitions=None) -> DataFrame:
    """The engineered features of arriving flows, on frozen scaler statistics if given.

    ``partitions`` deals the rows of each batch to so many tasks; without it a batch of few
    files has as few tasks, however many cores there are.
    """
    flows = flows.repartition(partitions) if partitions else flows
    return add_engineered_features(apply_scaler(flows, stats) if stats is not None else flows)


def gap_panes(events: DataFrame, keys: list, ts_col: str, pane: str, delay: str) -> DataFrame:
    """Per key and pane: ``window``, ``_rows`` and ``_part`` (first and last time, moments of the gaps of different times).

    Times are collected per pane, where their distinct microseconds bound them, so a hot
    key is spread over its panes. On a stream a pane comes out once the watermark has passed it.
    """
    us = micros(events, ts_col)
    rows = events.select(*keys, F.timestamp_micros(us).alias("_ts"), us.alias("_us"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", delay)
    panes = rows.groupBy(F.window("_ts", pane), *keys).agg(
        F.sort_array(F.collect_set("_us")).alias("_t"), F.count(F.lit(1)).alias("_rows")
    )
    inner = lambda t: F.transform(
        F.slice(t, 2, F.size(t) - 1), lambda v, i: (v - F.get(t, i)) / F.lit(1e6)
    )

    def moments(g: Column, t: Column) -> Column:
        mean = F.aggregate(g, F.lit(0.0), lambda acc, v: acc + v) / F.greatest(F.size(g), F.lit(1))
        return let(
            mean,
            lambda m: F.struct(
                F.get(t, F.lit(0)).alias("first"),
                F.element_at(t, -1).alias("last"),
                F.size(g).cast("double").alias("n"),
                m.alias("mean"),
                F.aggregate(g, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)).alias("m2"),
            ),
        )

    return panes.select(
        "window", *keys, "_rows", let(inner(F.col("_t")), lambda g: moments(g, F.col("_t"))).alias("_part")
    )


def interarrival_windows(events: DataFrame, keys: list, ts_col: str, window: str = "1 hour",
                         pane: str = "1 second", delay: str = "10 minutes") -> DataFrame:
    """Gap deviation and coefficient of variation per key and tumbling window.

    Works on batch and streaming tables; on a stream, a window is emitted once the
    watermark has passed it. A window merges the moments of its panes.
    """
    parts = gap_panes(events, keys, ts_col, pane, delay)
    grouped = parts.groupBy(F.window(F.window_time("window"), window).alias("_window"), *keys).agg(
        F.sum("_rows").alias("events"), F.sort_array(F.collect_list("_part")).alias("_parts")
    )

    def group(n, mean, m2) -> Column:
        return F.struct(n.cast("double").alias("n"), mean.alias("mean"), m2.alias("m2"))

    # Gaps inside panes, gaps between panes, and gaps of equal times.
    known = F.aggregate("_parts", F.lit(0.0), lambda acc, v: acc + v.n + 1) - 1
    seams = F.transform(
        F.slice("_parts", 2, F.size("_parts") - 1),
        lambda v, i: group(F.lit(1), (v.first - F.get("_parts", i).last) / F.lit(1e6), F.lit(0.0)),
    )
    equal = group(F.col("events") - 1 - known, F.lit(ZERO_GAP), F.lit(0.0))
    groups = F.concat(
        F.transform("_parts", lambda v: group(v.n, v.mean, v.m2)), seams, F.array(equal)
    )

    def deviation(g: Column, mean: Column) -> Column:
        m2 = F.aggregate(
            g, F.lit(0.0), lambda acc, v: acc + v.m2 + v.n * (v.mean - mean) * (v.mean - mean)
        )
        gaps = F.col("events") - 1
        std = F.when(gaps == 1, 0.0).when(gaps > 1, F.sqrt(m2 / F.greatest(gaps - 1, F.lit(1))))
        return F.struct(std.alias("std"), mean.alias("mean"))

    def result(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda acc, v: acc + v.n * v.mean)
        return let(total / F.greatest(F.col("events") - 1, F.lit(1)), lambda m: deviation(g, m))

    return grouped.withColumn("_out", let(groups, result)).select(
        F.unix_micros("_window.start").alias("window_us"),
        *keys,
        "events",
        F.col("_out.std").alias("gap_std"),
        F.when(F.col("_out.mean") > 0, F.col("_out.std") / F.col("_out.mean")).alias("gap_cv"),
    )


def entropy_windows(events: DataFrame, keys: list, ts_col: str, payload_col: str, window: str = "1 hour",
                    delay: str = "10 minutes") -> DataFrame:
    """Entropy in bits of all payload bytes per key and tumbling window: ``(window_us, keys, bytes, entropy)``.

    Works on batch and streaming tables. Batches count their bytes first, so the state holds
    at most 257 rows per key and open window. On a stream time moves on with the starts of
    the windows seen: a window is emitted once one that starts ``delay`` after its end has
    arrived. A window of empty or NULL payloads has 0 bytes and no entropy; events without
    a time belong to no window.
    """
    ts = F.timestamp_micros(micros(events, ts_col))
    rows = events.select(ts.alias("_at"), *keys, payload_col).filter("_at IS NOT NULL")
    rows = rows.select(F.window("_at", window)["start"].alias("_start"), *keys, payload_col)
    counts = partial_byte_counts(rows, ["_start", *keys], payload_col)
    if events.isStreaming:
        counts = counts.withWatermark("_start", delay)
    counts = counts.groupBy(F.window("_start", window).alias("_window"), *keys, "byte").agg(F.sum("n").alias("n"))
    return counts.groupBy("_window", *keys).agg(*entropy_of_counts()).select(
        F.unix_micros("_window.start").alias("window_us"), *keys, "bytes", "entropy")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that has arrived into a Parquet sink and read the sink."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
