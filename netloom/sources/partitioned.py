"""Partitioned Parquet tables that stay right when a job is repeated or dies half way.

Files go to a folder of their own per attempt, ``<root>/data/_attempt=<id>/<by>=<value>/``, and count only once
a line of the manifest, ``<root>/manifest``, names the attempt. That line is appended as a single file after
the data is complete, so readers see all of a load or nothing of it. A load that is written again
under its name replaces what it wrote before; ``replace=True`` replaces partitions, of whatever load.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.sizing import join_small

# One row per attempt and partition; ``parts`` holds the partition's values as JSON.
_MANIFEST = "number long, attempt string, load string, replace boolean, parts string, rows long"
ATTEMPT = "_attempt"


def _parts(by: list):
    """Partition values as text; NULL is a value of its own."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in by]))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All committed attempts: ``(number, attempt, load, replace, parts, rows)``; empty before the first commit."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def stage(df: DataFrame, root: str, by: list, rows_per_file: int | None = None) -> str:
    """Write the files of a load below a fresh attempt; they do not count before ``commit``."""
    if not by or len(set(by)) < len(by) or ATTEMPT in df.columns:
        raise ValueError(f"name different partition columns; {ATTEMPT!r} is a column of the table's own")
    attempt = uuid.uuid4().hex
    writer = df.write.partitionBy(*by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{root.rstrip('/')}/data/{ATTEMPT}={attempt}")
    return attempt


def commit(spark: SparkSession, root: str, by: list, attempt: str, load: str, replace: bool, schema) -> None:
    """Append the attempt's lines to the manifest, in one file: a row per partition with its rows, and one of none.

    The latter keeps an empty load, which replaces an earlier one all the same.
    """
    root = root.rstrip("/")
    written = spark.read.schema(schema).parquet(f"{root}/data/{ATTEMPT}={attempt}")
    parts = written.groupBy(_parts(by).alias("parts")).agg(F.count(F.lit(1)).alias("rows"))
    none = spark.range(1).select(F.lit(None).cast("string").alias("parts"), F.lit(0).cast("long").alias("rows"))
    number = 1 + (manifest(spark, root).agg(F.max("number")).first()[0] or 0)
    lines = parts.unionByName(none).select(
        F.lit(number).cast("long").alias("number"), F.lit(attempt).alias("attempt"), F.lit(load).alias("load"),
        F.lit(replace).alias("replace"), "parts", "rows")
    lines.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def save_load(df: DataFrame, root: str, by: list, load: str, replace: bool = False, rows_per_file: int | None = None) -> None:
    """Write a load into the table at ``root``, partitioned by the columns ``by``.

    Rows add to those of other loads. A load of the same name is replaced whole, so a job may be run
    again after any failure. With ``replace`` every partition that ``df`` has rows for loses its
    earlier rows, other partitions keep theirs. All loads need the same columns.
    """
    attempt = stage(df, root, by, rows_per_file)
    commit(df.sparkSession, root, by, attempt, load, replace, df.schema)


def live_parts(spark: SparkSession, root: str) -> DataFrame:
    """``(attempt, load, parts, rows)`` of what counts now. Equal numbers of two writers at once go by attempt."""
    lines = manifest(spark, root).withColumn("at", F.struct("number", "attempt"))
    newest = F.max("at").over(Window.partitionBy("load"))
    current = lines.withColumn("_newest", newest).where("at = _newest AND parts IS NOT NULL")
    cut = F.max(F.when(F.col("replace"), F.col("at"))).over(Window.partitionBy("parts"))
    kept = current.withColumn("_cut", cut).where("_cut IS NULL OR at >= _cut")
    return kept.select("attempt", "load", "parts", "rows")


def read_table(spark: SparkSession, root: str, by: list, schema) -> DataFrame:
    """The committed rows, in the columns of ``schema``.

    Attempts that count are pruned to by folder (one name per load reaches the driver); a join with
    the manifest is needed only where partitions of a load were replaced.
    """
    live = live_parts(spark, root)
    attempts = [r["attempt"] for r in live.select("attempt").distinct().collect()]
    if not attempts:
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    files = T.StructType([*schema.fields, T.StructField(ATTEMPT, T.StringType())])
    data = spark.read.schema(files).parquet(f"{root.rstrip('/')}/data").where(F.col(ATTEMPT).isin(attempts))
    if not manifest(spark, root).where("replace").isEmpty():
        marked = data.withColumn("_parts", _parts(by))
        live = live.select(F.col("attempt").alias(ATTEMPT), F.col("parts").alias("_parts"))
        data = join_small(marked, live, [ATTEMPT, "_parts"], "left_semi")
    return data.select(*[F.col(f"`{n}`") for n in names])
