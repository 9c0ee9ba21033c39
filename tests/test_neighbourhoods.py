"""Rebalancing from stored neighbourhoods."""

import uuid

import numpy as np
import pytest

from netloom.operators import neighbourhoods, resample

NAMES = ["x", "y"]


def frame(spark, few=60, many=400):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(few + many, 2))
    points[:20] = points[0]  # copies
    return spark.createDataFrame([(i, float(a), float(b), int(i < few)) for i, (a, b) in enumerate(points)], "id long, x double, y double, label int")


def test_same_rows_as_smote_and_no_exchange_of_vectors(spark, tmp_path):
    df, name = frame(spark), f"near_{uuid.uuid4().hex}"
    neighbourhoods.store_neighbourhoods(df, "id", NAMES, name, 8, "label", k=4, path=str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large table
    try:
        for ratio in (0.5, 1.0):
            got = neighbourhoods.smote_stored(df, "id", NAMES, name, "label", 4, ratio)
            want = resample.smote(df, "id", NAMES, "label", 4, ratio)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    initial = plan[1].split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1 and "SortMergeJoin" in initial and "Bucketed: true" in initial
    sent = next(line for line in initial.splitlines() if "Exchange" in line)
    moved = sent + initial.split(sent)[1].split("Range")[0]
    assert "hashpartitioning(idx" in sent and "alpha" in moved and "vec" not in moved and "near" not in moved
    spark.sql(f"DROP TABLE {name}")


def test_refusals(spark, tmp_path):
    df, name = frame(spark), f"near_{uuid.uuid4().hex}"
    with pytest.raises(ValueError):
        neighbourhoods.store_neighbourhoods(frame(spark, 3), "id", NAMES, name, 2, "label", k=4)
    with pytest.raises(ValueError):
        neighbourhoods.store_neighbourhoods(df.where("label = 1"), "id", NAMES, name, 2, "label")
    neighbourhoods.store_neighbourhoods(df, "id", NAMES, name, 2, "label", path=str(tmp_path / "t"))
    with pytest.raises(ValueError):
        neighbourhoods.smote_stored(df.where("id <> 3"), "id", NAMES, name, "label")
    assert neighbourhoods.smote_stored(df, "id", NAMES, name, "label", ratio=0.0).count() == 460
    spark.sql(f"DROP TABLE {name}")
