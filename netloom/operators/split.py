"""Stratified splits, seeded shuffles and dense row numbers, without one-task windows."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.seeded import uniform
from netloom.plans.sizing import join_small
from netloom.schema import LABEL


def _bucket_count(df: DataFrame) -> int:
    """The square root of the number of rows: so many buckets, of about so many rows each."""
    return max(1, math.isqrt(df.count()))


def _bucket(u, count: int):
    return F.floor(u * count).cast("bigint")


def _offsets(buckets: DataFrame, group: list) -> DataFrame:
    """Rows of earlier buckets and rows in all, per group: one row per bucket in a group."""
    within = Window.partitionBy(*group)
    before = within.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_total": F.sum("_rows").over(within),
        }
    )


def dense_index(df: DataFrame, id_col: str, seed, tag: str, group=(), out: str = "idx") -> DataFrame:
    """Row number 0..n-1 in seeded random order, per group.

    Rows are ranked inside buckets of the hash range and shifted by the size of
    the earlier buckets, so that no task sorts a whole group. For n rows there are
    about sqrt(n) buckets, and no sort group has more than about sqrt(n) rows.
    """
    group = list(group)
    count = _bucket_count(df.select(id_col))
    keyed = df.withColumn("_u", uniform(seed, tag, id_col)).withColumn("_bucket", _bucket(F.col("_u"), count))
    buckets = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(buckets, group).drop("_rows", "_total")
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_u", id_col))
    ranked = keyed.withColumn("_rank", rank.cast("bigint"))
    return join_small(ranked, offsets, group + ["_bucket"]).withColumn(
        out, F.col("_offset") + F.col("_rank") - 1
    ).drop("_u", "_bucket", "_rank", "_offset")


def seeded_shuffle(df: DataFrame, id_col: str, seed=42) -> DataFrame:
    """The table in seeded random order (a distributed range sort)."""
    u = uniform(seed, "shuffle", id_col)
    return df.withColumn("_u", u).orderBy("_u", id_col).drop("_u")


def stratified_split(df: DataFrame, id_col: str, label_col: str = LABEL, seed=42,
                     holdout: float = 0.4, test_share: float = 0.5) -> DataFrame:
    """Add ``split``: train, val or test, in fixed shares of every label.

    Per label, ceil(n * holdout) rows leave the training part and
    ceil(that * test_share) of them form the test part. Only the two buckets that
    hold a cut are ranked; all other rows compare their hash with the cut, so the
    table itself is never shuffled.
    """
    u = uniform(seed, "split", id_col)
    count = _bucket_count(df.select(id_col))
    keyed = df.select(
        F.col(label_col).alias("_label"), F.col(id_col).alias("_id"), u.alias("_u")
    ).withColumn("_bucket", _bucket(F.col("_u"), count))
    buckets = keyed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    total = F.col("_total")
    rest = F.ceil(total * F.lit(float(holdout)))
    test = F.ceil(rest * F.lit(float(test_share)))
    cut = F.explode(
        F.array(
            F.struct(F.lit("train").alias("part"), (total - rest).alias("at")),
            F.struct(F.lit("val").alias("part"), (total - test).alias("at")),
        )
    )
    # The cut is the first row that no longer belongs to the part.
    wanted = (
        _offsets(buckets, ["_label"])
        .select("_label", "_bucket", "_offset", "_rows", cut.alias("cut"))
        .filter("cut.at >= _offset AND cut.at < _offset + _rows")
        .select("_label", "_bucket", F.col("cut.part").alias("part"),
                (F.col("cut.at") - F.col("_offset") + 1).alias("_want"))
    )
    rank = F.row_number().over(Window.partitionBy("_label", "_bucket", "part").orderBy("_u", "_id"))
    cuts = (
        join_small(keyed, wanted, ["_label", "_bucket"])
        .withColumn("_rank", rank)
        .filter("_rank = _want")
        .groupBy("_label")
        .agg(
            *[
                F.min(F.when(F.col("part") == p, F.struct("_u", "_id"))).alias(f"_{p}")
                for p in ("train", "val")
            ]
        )
        .withColumnRenamed("_label", label_col)
    )
    here = F.struct(u.alias("_u"), F.col(id_col).alias("_id"))
    before = lambda p: F.col(f"_{p}").isNull() | (F.col("_here") < F.col(f"_{p}"))
    tagged = join_small(df.withColumn("_here", here), cuts, [label_col], "left")
    return tagged.withColumn(
        "split", F.when(before("train"), "train").when(before("val"), "val").otherwise("test")
    ).drop("_here", "_train", "_val")
