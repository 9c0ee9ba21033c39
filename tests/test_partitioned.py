"""Loads that are repeated, replaced or die half way."""

import pytest
from pyspark.sql import functions as F

from netloom.sources import partitioned

SCHEMA = "id long, kind string, day int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(spark, root):
    df = partitioned.read_table(spark, root, ["kind", "day"], frame(spark, []).schema)
    return sorted(map(tuple, df.collect()), key=str)


def test_repeat_crash_and_replace(spark, tmp_path):
    root, by = str(tmp_path / "t"), ["kind", "day"]
    assert rows(spark, root) == []
    one = [(1, "a", 1), (2, "b", 1), (3, None, 1), (4, "a", None), (5, "a b/c=d", 2)]
    two = [(6, "a", 1), (7, "b", 2)]
    partitioned.save_load(frame(spark, one), root, by, "one")
    partitioned.save_load(frame(spark, two), root, by, "two")
    assert rows(spark, root) == sorted(one + two, key=str)
    partitioned.save_load(frame(spark, one), root, by, "one")  # the same job again
    assert rows(spark, root) == sorted(one + two, key=str)
    partitioned.stage(frame(spark, two), root, by)  # a job that died before its commit
    assert rows(spark, root) == sorted(one + two, key=str)
    partitioned.save_load(frame(spark, [(8, "b", 1)]), root, by, "one")  # without its other partitions
    assert rows(spark, root) == sorted([(8, "b", 1)] + two, key=str)
    fresh = [(9, "a", 1), (10, "c", 3)]
    partitioned.save_load(frame(spark, fresh), root, by, "three", replace=True)  # only the partitions it has
    assert rows(spark, root) == sorted([(7, "b", 2), (8, "b", 1), *fresh], key=str)
    partitioned.save_load(frame(spark, [(11, "a", 1)]), root, by, "four")
    assert (11, "a", 1) in rows(spark, root) and (9, "a", 1) in rows(spark, root)
    partitioned.save_load(frame(spark, []), root, by, "four")  # an empty load empties its own
    assert rows(spark, root) == sorted([(7, "b", 2), (8, "b", 1), *fresh], key=str)
    live = partitioned.live_parts(spark, root).agg(F.sum("rows")).first()[0]
    assert live == 4


def test_task_failures_leave_nothing(spark, tmp_path):
    """A job that fails in some tasks, after others have written, changes nothing for readers."""
    root, by = str(tmp_path / "t"), ["kind", "day"]
    good = [(i, "a", i % 3) for i in range(30)]
    partitioned.save_load(frame(spark, good), root, by, "day")
    broken = frame(spark, good).withColumn("id", F.when(F.col("id") == 29, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        partitioned.save_load(broken, root, by, "day")
    assert rows(spark, root) == sorted(good, key=str)


def test_pruning_and_names(spark, tmp_path):
    root = str(tmp_path / "t")
    df = frame(spark, [(1, "a", 1), (2, "b", 1)])
    partitioned.save_load(df, root, ["kind"], "x")
    plan = partitioned.read_table(spark, root, ["kind"], df.schema).where("kind = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "kind" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Exchange" not in plan
    with pytest.raises(ValueError):
        partitioned.save_load(df, root, [], "x")
    with pytest.raises(ValueError):
        partitioned.save_load(df.withColumn("_attempt", F.lit("")), root, ["kind"], "x")
