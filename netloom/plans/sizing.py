"""Joins with small tables, and lineage cuts that survive executor loss."""

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Deletes the files of an execution's exchanges when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of each open ``step`` the tables written in it.
_steps = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode.

    On a cluster the setting is required. It may name a ``file:`` folder if that is mounted
    on all machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="netloom-checkpoint-")
    context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/netloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def exchanges_deleted(spark: SparkSession):
    """A write inside deletes what was exchanged for it when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, yet keeps column pruning and
    file statistics for the plans that follow. What was exchanged on the way is deleted
    with the write, as nothing reads it again: disk holds the tables and the exchanges of one step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with exchanges_deleted(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _steps:
        _steps[-1].append(table)
    return table


@contextlib.contextmanager
def step():
    """Deletes what ``durable`` writes inside, at the end: for a step whose whole result is written elsewhere by then."""
    _steps.append([])
    try:
        yield
    finally:
        for table in _steps.pop():
            release(table)


def release(table: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once all that was made of it is written too."""
    spark = table.sparkSession
    scratch = checkpoint_root(spark).split(":", 1)[-1].rstrip("/") + "/netloom/"
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if scratch in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: list, how: str = "inner", stored: bool = False) -> DataFrame:
    """Join on null-safe equality of ``on`` with a table that is often small.

    ``small`` is written once. Spark broadcasts what it reads back if its files are below
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise it shuffles both sides and splits
    skewed partitions at run time. ``stored`` says that ``small`` is a written table already.
    """
    table = small if stored else durable(small, "small")
    right = table.select(
        *[F.col(c).alias(f"__{c}") for c in on],
        *[c for c in small.columns if c not in on],
    )
    condition = None
    for c in on:
        test = big[c].eqNullSafe(right[f"__{c}"])
        condition = test if condition is None else condition & test
    return big.join(right, condition, how).drop(*[f"__{c}" for c in on])
