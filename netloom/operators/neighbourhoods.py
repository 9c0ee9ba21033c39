"""Rebalancing from stored neighbourhoods: minority vectors move once, not for every rebalanced table.

``store_neighbourhoods`` writes one row per minority row, its vector with those of its k nearest
neighbours, into a bucketed and sorted catalogue table. ``smote_stored`` joins the narrow draws (a few
numbers each) with it: only the draws are exchanged, the vectors are read where they lie. Other
ratios need no new search; the synthetic rows are those of ``smote`` with the same seed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.seeded import uniform
from netloom.operators.neighbors import knn
from netloom.operators.profile import class_counts
from netloom.operators.resample import _checked, _original, synthetic_count
from netloom.operators.split import dense_index
from netloom.plans.sizing import durable
from netloom.schema import LABEL


def _two_classes(df: DataFrame, label_col: str) -> list:
    counts = class_counts(df, label_col)
    if len(counts) != 2 or any(label is None for label, _ in counts):
        raise ValueError("two classes, and a label in every row, are needed")
    return counts


def store_neighbourhoods(df: DataFrame, id_col: str, features: list, table: str, buckets: int, label_col: str = LABEL,
                         k: int = 5, seed=42, metric: str = "euclidean", p: float = 2.0, path: str | None = None) -> None:
    """Write ``(idx, id, vec, near)`` of all minority rows as the catalogue table ``table``, in ``buckets`` buckets of ``idx``.

    ``near`` holds the vectors of the k nearest minority rows in order, so a row takes k + 1 vectors. A
    bucket is one task of every later join: choose as many as keep it to some 100 MB. The files go to
    the warehouse, or to the shared folder ``path``. An existing table is an error, as is input that ``smote`` refuses.
    """
    (minority, rows), _ = _two_classes(df, label_col)
    if rows <= k:
        raise ValueError(f"{rows} minority rows are too few for k = {k}")
    _checked(df, id_col, features, label_col, minority)
    vectors = df.where(F.col(label_col) == F.lit(minority)).select(
        F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vec"))
    pool = durable(dense_index(vectors, "id", seed, "smote.pool"), "minority")
    ranked = knn(pool, k, metric, "id", "vec", p).select("id", "rank", "neighbor_id")
    others = pool.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("other"))
    near = ranked.join(others, "neighbor_id").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda t: t["other"]).alias("near"))
    whole = pool.join(near, "id").select("idx", "id", "vec", "near")
    writer = whole.repartition(buckets, "idx").write.bucketBy(buckets, "idx").sortBy("idx").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def draws(spark: SparkSession, wanted: int, rows: int, k: int, seed) -> DataFrame:
    """``(n, idx, rank, alpha)`` of the synthetic rows, the draws of ``smote``."""
    pick = lambda tag, size: F.floor(uniform(seed, tag, "n") * size)
    return spark.range(wanted).select(F.col("id").alias("n")).select(
        "n", pick("smote.row", rows).cast("bigint").alias("idx"), (pick("smote.neighbour", k) + 1).cast("int").alias("rank"),
        uniform(seed, "smote.alpha", "n").alias("alpha"))


def smote_stored(df: DataFrame, id_col: str, features: list, table: str, label_col: str = LABEL, k: int = 5,
                 ratio: float = 1.0, seed=42) -> DataFrame:
    """``smote`` of ``df`` with the neighbourhoods stored in ``table`` for the same rows, features, ``k`` and seed.

    Any ``ratio`` goes with one table. A table of another number of rows is refused.
    """
    (minority, rows), (_, others) = _two_classes(df, label_col)
    original = _original(df, id_col, features, label_col)
    wanted = synthetic_count(rows, others, ratio)
    if wanted <= 0:
        return original
    lowest = _checked(df, id_col, features, label_col, minority)
    stored = df.sparkSession.table(table)
    if stored.count() != rows:
        raise ValueError(f"{table} was stored for other rows")
    met = draws(df.sparkSession, wanted, rows, k, seed).join(stored.select("idx", "vec", "near"), "idx")
    other = F.get("near", F.col("rank") - 1)
    mixed = met.select("n", F.zip_with("vec", other, lambda x, y: x + F.col("alpha") * (y - x)).alias("z"))
    synthetic = mixed.select(
        (F.lit(lowest) - 1 - F.col("n")).cast(dict(df.dtypes)[id_col]).alias(id_col),
        *[F.get("z", F.lit(i)).alias(c) for i, c in enumerate(features)],
        F.lit(minority).cast(dict(df.dtypes)[label_col]).alias(label_col), F.lit(True).alias("is_synthetic"))
    return original.unionByName(synthetic)
