"""Profiles of parts, merged; scaler statistics of batches that may be replayed."""

import math

import numpy as np
import pytest

from netloom.operators.mergeable import RANK_ERROR, merge_profiles, profile_parts, store_part, stored_parts
from netloom.operators.scale import fit_scaler
from netloom.streaming import flow_stream, scaler_stream


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v), i % 7) for i, v in enumerate(values)], "id int, x double, part int")


def test_merged_parts_equal_the_whole(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([1e9 + rng.normal(size=4000), [1e9 - 50]])
    df = frame(spark, [*values, None, math.nan])
    parts = profile_parts(df, ["x", "id"], ["part"])
    assert parts.count() == 14
    row = {r["feature"]: r for r in merge_profiles(parts).collect()}["x"]
    assert row["count"] == 4001 and row["min"] == values.min() and row["max"] == values.max()
    assert row["mean"] == pytest.approx(values.mean(), rel=1e-15) and row["std"] == pytest.approx(values.std(ddof=1), rel=1e-6)
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert (values < row[name]).mean() - RANK_ERROR <= p <= (values <= row[name]).mean() + RANK_ERROR


def test_new_part_and_replaced_part(spark, tmp_path):
    store = str(tmp_path / "store")
    store_part(frame(spark, [1, 2, 3]), ["x"], store, 0)
    store_part(frame(spark, [100, 200]), ["x"], store, 1)
    store_part(frame(spark, [10, 20]), ["x"], store, 1)  # again, other rows
    store_part(frame(spark, [None, None]), ["x"], store, 2)
    one = merge_profiles(stored_parts(spark, store)).first()
    assert (one["count"], one["min"], one["max"]) == (5, 1.0, 20.0) and one["mean"] == pytest.approx(36 / 5)
    assert one["std"] == pytest.approx(np.std([1, 2, 3, 10, 20], ddof=1))
    assert merge_profiles(stored_parts(spark, store, 0)).first()["count"] == 3
    nothing = merge_profiles(profile_parts(frame(spark, [None]), ["x"])).first()
    assert nothing["count"] == 0 and nothing["mean"] is None and nothing["p50"] is None
    empty = merge_profiles(profile_parts(frame(spark, []), ["x"])).first()
    assert empty["count"] == 0


def test_scaler_counts_each_batch_once(spark, tmp_path):
    arriving, store = tmp_path / "in", str(tmp_path / "store")
    whole = frame(spark, np.random.default_rng(1).normal(size=300) * 5 + 2)
    whole.where("id < 200").repartition(4).write.parquet(str(arriving))
    read = lambda: flow_stream.read_stream(spark, str(arriving), whole.schema, files_per_trigger=1)
    scaler_stream.run_learning(read(), ["x"], store, str(tmp_path / "progress"))
    batches = stored_parts(spark, store).select("part").distinct().count()
    assert batches > 1
    # A batch that failed behind its write comes again under its number.
    again = whole.where("id < 200")
    first = stored_parts(spark, store).where("part = 0").first()
    scaler_stream.learn(["x"], store)(again.limit(0), batches)  # an empty batch changes nothing
    whole.where("id >= 200").write.mode("append").parquet(str(arriving))
    scaler_stream.run_learning(read(), ["x"], store, str(tmp_path / "progress"))
    want, got = fit_scaler(whole, ["x"]).first(), scaler_stream.learned_scaler(spark, store).first()
    assert got["mean"] == pytest.approx(want["mean"]) and got["std"] == pytest.approx(want["std"])
    scaler_stream.learn(["x"], store)(spark.createDataFrame([(0, v, 0) for v in np.full(first["n"], first["mean"]).tolist()], whole.schema), 0)
    once = scaler_stream.learned_scaler(spark, store).first()
    assert once["mean"] == pytest.approx(want["mean"])  # replaced, not added
    assert scaler_stream.learned_scaler(spark, store, 0).first()["std"] == pytest.approx(0.0, abs=1e-9)
