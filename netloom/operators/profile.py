"""Column profiles, class counts and histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.safety import valid_in
from netloom.operators.clean import columns_of_type
from netloom.operators.mergeable import merge_profiles, profile_parts
from netloom.operators.quantiles import exact_quantiles
from netloom.plans.sizing import durable, join_small
from netloom.schema import ATTACK, ID_COLS, LABEL

_NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list:
    return columns_of_type(df, *_NUMBERS)


def describe(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column.

    Exact quartiles take up to three scans, the first of which gives all else; with
    ``approx`` a single scan gives sketched ones (see ``mergeable``).
    """
    columns = columns or numeric_columns(df)
    if approx:
        return merge_profiles(profile_parts(df, columns)).drop("std_pop")
    moments: dict = {}  # filled by the scan that brackets the quartiles
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], moments=moments)
    basic = df.sparkSession.createDataFrame(
        [(c, *moments[c]) for c in columns], "feature string, count bigint, mean double, std double, min double, max double")
    quartiles = (
        found.groupBy("feature")
        .agg(
            *[
                F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("value"))).alias(name)
                for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
            ]
        )
    )
    return basic.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def class_counts(df: DataFrame, label_col: str = LABEL, first: int = 3) -> list:
    """``[(label, rows)]`` of the ``first`` smallest classes, ties by label, NULL before all labels.

    However many classes there are, only these rows reach the driver.
    """
    counts = df.groupBy(label_col).count()
    return [(r[0], r["count"]) for r in counts.orderBy("count", label_col).limit(first).collect()]


def class_balance(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Rows per class and their ratio to the class with the smallest label."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    summary = counts.agg(
        F.sum("n").alias("total"),
        F.min(F.struct(label_col, "n")).getField("n").alias("first_n"),
        F.min(F.struct("n", label_col)).getField(label_col).alias("minority"),
    )
    whole = summary.select(F.struct("total", "first_n", "minority")).scalar()
    return counts.withColumn("_whole", whole).select(
        label_col,
        "n",
        (F.col("n") / F.col("_whole.first_n")).alias("ratio"),
        (F.col("n") / F.col("_whole.total")).alias("share"),
        (F.col(label_col) == F.col("_whole.minority")).alias("is_minority"),
    )


def histogram(df: DataFrame, columns=None, bins: int = 10, by: str = None) -> DataFrame:
    """Equal-width histogram per column (and per value of ``by``), with empty bins.

    Bins span each group's own minimum to maximum; the last one is closed. A column
    with a single value x gets the range x - 0.5 .. x + 0.5.
    """
    columns = columns or [
        c for c in numeric_columns(df) if c not in ID_COLS and c not in (LABEL, ATTACK, by)
    ]
    keys = [by] if by else ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    ranges = df.groupBy(*keys).agg(
        F.array(*[F.min(valid_in(df, c)) for c in columns]).alias("lo"),
        F.array(*[F.max(valid_in(df, c)) for c in columns]).alias("hi"),
    )
    flat = lambda low, high, shift: F.when(low == high, low + shift)
    ranges = durable(
        ranges.select(
            *keys,
            F.zip_with("lo", "hi", lambda a, b: F.coalesce(flat(a, b, -0.5), a)).alias("lo"),
            F.zip_with("lo", "hi", lambda a, b: F.coalesce(flat(a, b, 0.5), b)).alias("hi"),
        )
    )
    # One small array of bin numbers per row; only (column, bin) pairs are counted.
    rows = df.select(*keys, F.array(*[valid_in(df, c) for c in columns]).alias("v"))
    placed = join_small(rows, ranges, keys, stored=True)
    slot = F.transform(
        "v",
        lambda v, i: F.least(
            F.floor((v - F.get("lo", i)) / (F.get("hi", i) - F.get("lo", i)) * bins) + 1, F.lit(bins)
        ).cast("int"),
    )
    counted = (
        placed.select(*keys, F.posexplode(slot).alias("column", "bin"))
        .groupBy(*keys, "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    zipped = F.arrays_zip(names.alias("feature"), F.col("lo"), F.col("hi"))
    grid = (
        ranges.select(*keys, F.posexplode(zipped).alias("column", "z"))
        .select(*keys, "column", "z.feature", "z.lo", "z.hi")
        .filter("lo IS NOT NULL")
        .withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, [*keys, "column", "bin"], "left").select(
        *([by] if by else []),
        "feature",
        "bin",
        (F.col("lo") + step * (F.col("bin") - 1)).alias("bin_low"),
        (F.col("lo") + step * F.col("bin")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
