"""Exact quantiles of many groups at once, by selecting ranks digit by digit.

A value becomes a whole number of 64 bits in the same order. Counts per (group, leading
digit) tell which digit holds a wanted rank and how many values of it lie below; only the
values with that digit are kept, and the next digit is counted. After four digits of 16
bits the value is known. No values are sorted or gathered: a task orders at most 2^16
counts of one group at a time, so a group may hold any share of the rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.safety import finite_or_null, valid_in
from netloom.plans.sizing import durable, join_small

DIGIT_BITS = 16
_DIGITS = 64 // DIGIT_BITS
_SIGN = np.int64(63)
_REST = np.int64((1 << 63) - 1)


@F.pandas_udf(T.LongType())
def _ordered(value: pd.Series) -> pd.Series:
    """A whole number per double, in the order of the doubles; both zeros are one."""
    bits = (value.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> _SIGN) & _REST))


@F.pandas_udf(T.DoubleType())
def _restored(key: pd.Series) -> pd.Series:
    bits = key.to_numpy(dtype=np.int64)
    return pd.Series((bits ^ ((bits >> _SIGN) & _REST)).view(np.float64))


def _prefix(level: int) -> Column:
    """The leading ``level`` digits of a key."""
    return F.shiftright("_key", 64 - DIGIT_BITS * level)


def grouped_quantiles(df: DataFrame, keys: list, columns: list, probs: list) -> DataFrame:
    """Linearly interpolated quantiles of every group: ``(keys, feature, prob, n, value)``.

    ``n`` counts the values of a group that are neither NULL nor NaN; a group without such
    values of a column has no rows for it. A NULL key is a group of its own. An empty table
    gives no rows.
    """
    probs = sorted({float(p) for p in probs})
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    names = [f"_g{i}" for i in range(len(keys))]
    long = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.explode(F.array(*[
        F.struct(F.lit(i).alias("column"), valid_in(df, c).alias("v")) for i, c in enumerate(columns)])).alias("_e"))
    long = long.select(*names, F.col("_e.column").alias("_column"), F.col("_e.v").alias("_v")).where("_v IS NOT NULL")
    group = [*names, "_column"]
    values = long.select(*group, _ordered("_v").alias("_key"), F.lit(1).cast("long").alias("_rows"))
    wanted, sizes = None, None
    for level in range(1, _DIGITS + 1):
        counts = durable(values.groupBy(*group, _prefix(level).alias("_digit")).agg(F.sum("_rows").alias("_rows")), "digits")
        if wanted is None:
            sizes = durable(counts.groupBy(*group).agg(F.sum("_rows").alias("_n")), "group-sizes")
            ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(up).alias("up")) for p in probs for up in (0, 1)])
            wanted = sizes.withColumn("_w", F.explode(ranks)).select(
                *group, "_w.p", "_w.up", F.lit(0).cast("long").alias("_parent"),
                F.least(F.floor(F.col("_w.p") * (F.col("_n") - 1)) + F.col("_w.up"), F.col("_n") - 1).cast("long").alias("_rank"))
        parent = F.shiftright("_digit", DIGIT_BITS) if level > 1 else F.lit(0).cast("long")
        within = Window.partitionBy(*group, "_parent").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        spans = counts.withColumn("_parent", parent).withColumn("_upto", F.sum("_rows").over(within))
        # One row per group, column and wanted rank; each lies in one span.
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*group, "_parent")]
        inside = (F.col("w._rank") < F.col("s._upto")) & (F.col("w._rank") >= F.col("s._upto") - F.col("s._rows"))
        for c in same:
            inside = inside & c
        wanted = durable(wanted.alias("w").join(spans.alias("s"), inside).select(
            *[F.col(f"w.{c}").alias(c) for c in group], "w.p", "w.up", F.col("s._digit").alias("_parent"),
            (F.col("w._rank") - F.col("s._upto") + F.col("s._rows")).alias("_rank")), "wanted")
        if level < _DIGITS:
            kept = durable(wanted.select(*group, F.col("_parent").alias("_prefix")).distinct(), "kept-digits")
            values = values.withColumn("_prefix", _prefix(level))
            values = join_small(values, kept, [*group, "_prefix"], "leftsemi", stored=True).drop("_prefix")
            values = durable(values.groupBy(*group, "_key").agg(F.sum("_rows").alias("_rows")), "kept-values")
    ends = wanted.withColumn("_x", _restored("_parent")).groupBy(*group, "p").agg(
        F.max(F.when(F.col("up") == 0, F.col("_x"))).alias("_x0"), F.max(F.when(F.col("up") == 1, F.col("_x"))).alias("_x1"))
    out = join_small(ends, sizes, group, stored=True)
    position = F.col("p") * (F.col("_n") - 1)
    share = position - F.floor(position)
    value = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * share
    feature = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_column"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], feature.alias("feature"),
                      F.col("p").alias("prob"), F.col("_n").alias("n"),
                      F.when((F.col("_x0") == F.col("_x1")) | (share == 0), F.col("_x0")).otherwise(value).alias("value"))


def impute_by_group(df: DataFrame, keys: list, columns: list, strategy: str = "median") -> DataFrame:
    """Fill missing values with the mean or median of their group; a group without any value keeps them missing.

    NULL, NaN and infinite values are missing. A NULL key is a group of its own.
    """
    finite = df.withColumns({c: finite_or_null(c) for c in columns})
    if strategy == "median":
        long = grouped_quantiles(finite, keys, columns, [0.5])
        fills = long.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_fill{i}")
                                          for i, c in enumerate(columns)])
    elif strategy == "mean":
        fills = finite.groupBy(*keys).agg(*[F.avg(c).alias(f"_fill{i}") for i, c in enumerate(columns)])
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    filled = join_small(finite, fills, keys, "left")
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_fill{i}") for i, c in enumerate(columns)}).select(*df.columns)
