"""Column profiles that are kept per part of a table and merged without reading it again.

A part (a day, a file, a micro-batch) leaves one small row per column: counts, moments,
extremes and a quantile sketch. Rows of any parts merge into the profile of all of them, so
a new part costs one scan of that part. Writing a part twice replaces it: a retried part
counts once.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.safety import valid_in

# Size parameter of the sketches; their rank error is below RANK_ERROR.
SKETCH_K = 400
RANK_ERROR = 0.02
QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
PART = "part long, feature string, n long, mean double, m2 double, low double, high double, sketch binary"


def profile_parts(df: DataFrame, columns: list, by: list = ()) -> DataFrame:
    """``(by, feature, n, mean, m2, low, high, sketch)``: one row per part and column, in one scan.

    NULL and NaN values are left out; a column without values in a part has n = 0.
    """
    stats = []
    for i, c in enumerate(columns):
        v = valid_in(df, c)
        stats += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.var_pop(v).alias(f"v{i}"),
                  F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"k{i}")]
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"),
                 (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"),
                 F.col(f"k{i}").alias("sketch"))
        for i, c in enumerate(columns)
    ]
    return df.groupBy(*by).agg(*stats).select(*by, F.inline(F.array(*rows)))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """The profile of all parts: ``(feature, count, mean, std, std_pop, min, p25, p50, p75, max)``.

    Counts, moments and extremes are those of all rows; quartiles are values whose rank is
    off by RANK_ERROR at most. A column without values has the count 0 and NULLs.
    """
    every = Window.partitionBy("feature")
    mean = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    # Deviations are added around the common mean, which cancels nothing.
    known = parts.where("n > 0").withColumn("_mean", mean)
    m2 = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    merged = known.groupBy("feature").agg(
        F.sum("n").alias("count"), F.first("_mean").alias("mean"), m2.alias("_m2"), F.min("low").alias("min"),
        F.max("high").alias("max"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    quartiles = [F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(name) for name, p in QUARTILES]
    names = parts.select("feature").distinct()
    n = F.col("count")
    return names.join(merged, "feature", "left").select(
        "feature", F.coalesce(n, F.lit(0)).alias("count"), "mean", F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))).alias("std"),
        F.sqrt(F.col("_m2") / n).alias("std_pop"), "min", *quartiles, "max")


def store_part(df: DataFrame, columns: list, store: str, part: int) -> None:
    """Scan one part and write its rows below ``store``, in place of earlier ones of the same number."""
    profile_parts(df, columns).write.mode("overwrite").parquet(f"{store.rstrip('/')}/part={int(part)}")


def stored_parts(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The rows of all stored parts, or of those numbered ``upto`` at most: that version of the profile."""
    parts = spark.read.schema(PART).option("basePath", store).parquet(store)
    return parts if upto is None else parts.where(F.col("part") <= upto)
