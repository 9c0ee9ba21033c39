"""The most frequent values of a column with very many different ones, exactly.

A summary of bounded size bounds every value's count from above: rows are counted per
hash bucket, in HASHES independent ways, and a frequent-items sketch proposes candidates. The
exact counts of the candidates give a floor under the k-th highest count; only values whose
buckets all reach that floor can be among the first k, and only they are counted by
value. The sketch may miss a value, the buckets cannot: the result is always that of counting
every value. Summaries of parts of a table (days, files, micro-batches) add up.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.sizing import durable, join_small

HASHES = 2
BUCKETS = 1 << 16
# Items the sketch keeps.
TRACKED = 4096


def _bucket(value: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), value), F.lit(BUCKETS)).cast("int")


def summarise(df: DataFrame, column: str, tracked: int = TRACKED) -> tuple:
    """(sketch, buckets) of a table or part: one row, and at most HASHES * BUCKETS rows ``(hash, bucket, n)``."""
    value = F.col(f"`{column}`")
    sketch = df.agg(F.call_function("approx_top_k_accumulate", value, F.lit(tracked)).alias("sketch"))
    places = F.array(*[F.struct(F.lit(i).alias("hash"), _bucket(value, i).alias("bucket")) for i in range(HASHES)])
    buckets = df.select(F.inline(places)).groupBy("hash", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return sketch, buckets


def _candidates(sketches: DataFrame, k: int, tracked: int) -> DataFrame:
    """``(value)``: the first ``k`` values of merged sketches."""
    merged = sketches.agg(F.call_function("approx_top_k_combine", "sketch", F.lit(tracked)).alias("s"))
    items = F.call_function("approx_top_k_estimate", "s", F.lit(k))
    return merged.select(F.explode(items).alias("item")).select(F.col("item.item").alias("value"))


def top_values(df: DataFrame, column: str, k: int = 100, summary: tuple | None = None, tracked: int = TRACKED) -> DataFrame:
    """``(column, n)``: the ``k`` most frequent values with their exact counts, ties to the smaller value.

    NULL counts as a value, before all others in a tie; fewer than ``k`` different values give
    all of them, an empty table none. ``summary`` is that of all rows of ``df`` if it is at hand (see
    ``stored_summary``); rows of ``df`` are then read twice, narrowly. Where counts are almost
    level the floor excludes little and nearly all rows are counted by value.
    """
    if not 0 < k <= tracked:
        raise ValueError(f"k must lie between 1 and {tracked}")
    rows = df.select(F.col(f"`{column}`").alias("value"))
    sketches, buckets = summary or summarise(rows, "value", tracked)
    count = F.count(F.lit(1)).alias("n")
    proposed = durable(_candidates(sketches, k, tracked), "candidates")
    known = join_small(rows, proposed, ["value"], "left_semi", stored=True).groupBy("value").agg(count)
    # At most k numbers; without k candidates there is no floor.
    counts = [r["n"] for r in known.select("n").collect()]
    floor = min(counts) if len(counts) == k else 0
    able = durable(buckets.where(F.col("n") >= floor).select("hash", "bucket"), "buckets")
    for i in range(HASHES if floor else 0):
        heavy = able.where(F.col("hash") == i).select("bucket")
        rows = join_small(rows.withColumn("bucket", _bucket(F.col("value"), i)), heavy, ["bucket"], "left_semi").drop("bucket")
    first = rows.groupBy("value").agg(count).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
    return first.select(F.col("value").alias(column), "n")


def store_summary(df: DataFrame, column: str, store: str, part: int, tracked: int = TRACKED) -> None:
    """Write the summary of one part below ``store``, in place of an earlier one of the same number."""
    sketch, buckets = summarise(df, column, tracked)
    sketch.write.mode("overwrite").parquet(f"{store.rstrip('/')}/sketch/part={int(part)}")
    buckets.write.mode("overwrite").parquet(f"{store.rstrip('/')}/buckets/part={int(part)}")


def stored_summary(spark: SparkSession, store: str) -> tuple:
    """The merged (sketches, buckets) of all stored parts, for ``top_values``."""
    root = store.rstrip("/")
    buckets = spark.read.parquet(f"{root}/buckets").groupBy("hash", "bucket").agg(F.sum("n").alias("n"))
    return spark.read.parquet(f"{root}/sketch").select("sketch"), buckets
