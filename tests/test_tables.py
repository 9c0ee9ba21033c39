"""Cleaning, quantiles, profiles, splits and scaling on small and awkward tables."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions.seeded import uniform
from netloom.operators import clean, profile
from netloom.operators.quantiles import exact_quantiles
from netloom.operators.scale import apply_scaler, fit_scaler, scale
from netloom.operators.split import dense_index, seeded_shuffle, stratified_split

NAN, INF = float("nan"), float("inf")


def test_drop_incomplete_checks_columns_before_dropping_them(spark):
    rows = [(1, 1.0, 1.0), (2, NAN, 1.0), (3, INF, 1.0), (4, 1.0, None), (5, -INF, 1.0), (6, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    kept = clean.drop_incomplete(df, drop_columns=["b"])
    assert kept.columns == ["id", "a"] and [r["id"] for r in kept.collect()] == [1]
    assert sorted(r["id"] for r in clean.drop_incomplete(df, subset=["b"]).collect()) == [1, 2, 3, 5, 6]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,), (NAN,)], "a double").coalesce(1)
    got = [r["a"] for r in clean.clip_upper(df, {"a": 4.0}).collect()]
    assert got[:3] == [1.0, 4.0, None] and np.isnan(got[3])


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (8.0,), (None,), (NAN,), (INF,)], "a double").coalesce(1)
    assert [r["a"] for r in clean.impute(df, ["a"], "mean").collect()] == [1, 3, 8, 4, 4, 4]
    assert [r["a"] for r in clean.impute(df, ["a"], "median").collect()] == [1, 3, 8, 3, 3, 3]
    assert clean.impute(df, ["a"], "drop").count() == 3
    with pytest.raises(ValueError):
        clean.impute(df, ["a"], "mode")


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    n = 4000
    skewed = np.exp(rng.normal(0, 3, n))
    tied = rng.choice([0.0, 0.0, 0.0, 1.0, 7.0], n)
    whole = rng.integers(-5, 5, n).astype(float)
    df = spark.createDataFrame(
        [tuple(map(float, t)) for t in zip(skewed, tied, whole)], "s double, t double, w double"
    ).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, ["s", "t", "w"], probs, accuracy).collect()}
    for name, values in (("s", skewed), ("t", tied), ("w", whole)):
        for p in probs:
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("accuracy", [2, 20, 10_000])
def test_exact_quantiles_narrowed(spark, accuracy):
    """Brackets that hold many values are cut down to the ranges around the position."""
    rng = np.random.default_rng(2)
    n = 6000
    values = np.concatenate([np.exp(rng.normal(0, 3, n // 2)), rng.integers(0, 50, n // 2).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(6)
    probs = [0.0, 0.001, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["s"], probs, accuracy, sort_values=8).collect()}
    assert got == pytest.approx({p: np.quantile(values, p) for p in probs}, rel=1e-12, abs=1e-12)


def test_exact_quantiles_edges(spark):
    df = spark.createDataFrame([(5.0, None), (None, None), (NAN, None)], "a double, b double")
    rows = exact_quantiles(df, ["a", "b"], [0.25, 0.99]).collect()
    assert sorted((r["feature"], r["value"]) for r in rows) == [("a", 5.0), ("a", 5.0)]
    assert exact_quantiles(df, [], [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [1.5])


def test_describe_empty_and_null(spark):
    df = spark.createDataFrame([], "a double, b bigint")
    rows = {r["feature"]: r for r in profile.describe(df).collect()}
    assert rows["a"]["count"] == 0 and rows["b"]["p50"] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500), np.full(500, 3.0)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    rows = profile.histogram(df, ["a", "b"], 10).collect()
    for name, values in (("a", a), ("b", b)):
        mine = sorted((r["bin"], r["n"]) for r in rows if r["feature"] == name)
        assert [n for _, n in mine] == np.histogram(values, 10)[0].tolist()


def test_class_counts_ties(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (0,)], "Label int")
    assert profile.class_counts(df) == [(0, 2), (1, 2)]


def _labels(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id bigint, Label string")


def test_split_shares_and_partitioning(spark):
    df = _labels(spark, {"a": 1000, "b": 10, "c": 1, "d": 2, "e": 3, "f": 5})
    one = {r["id"]: r["split"] for r in stratified_split(df.coalesce(1), "id").collect()}
    many = {r["id"]: r["split"] for r in stratified_split(df.repartition(13), "id").collect()}
    assert one == many and len(one) == 1021
    counts = {
        (r["Label"], r["split"]): r["count"]
        for r in stratified_split(df, "id").groupBy("Label", "split").count().collect()
    }
    assert [counts.get(("a", s), 0) for s in ("train", "val", "test")] == [600, 200, 200]
    assert [counts.get(("b", s), 0) for s in ("train", "val", "test")] == [6, 2, 2]
    assert [counts.get(("c", s), 0) for s in ("train", "val", "test")] == [0, 0, 1]
    other = {r["id"]: r["split"] for r in stratified_split(df, "id", seed=7).collect()}
    assert other != one


def test_split_keeps_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "id bigint, Label int")
    assert stratified_split(df, "id").filter("split IS NOT NULL").count() == 40


def test_dense_index_equals_plain_window(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, 0).otherwise(1))
    plain = F.row_number().over(Window.partitionBy("g").orderBy(uniform(9, "t", "id"), "id")) - 1
    both = dense_index(df.repartition(9), "id", 9, "t", ["g"]).join(df.withColumn("want", plain), ["id", "g"])
    assert both.filter("idx = want").count() == 3000


def test_seeded_shuffle_is_a_permutation(spark):
    df = spark.range(100)
    order = [r["id"] for r in seeded_shuffle(df, "id").collect()]
    again = [r["id"] for r in seeded_shuffle(df.repartition(5), "id").collect()]
    assert order == again and sorted(order) == list(range(100)) and order != sorted(order)


def test_scaler(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, "train"), (2.0, 5.0, "train"), (4.0, 5.0, "train"), (10.0, 6.0, "test")],
        "a double, b double, split string",
    ).coalesce(1)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in fit_scaler(df, ["a", "b"], "split").collect()}
    assert stats["a"] == pytest.approx((7 / 3, np.std([1, 2, 4]))) and stats["b"] == (5.0, 0.0)
    got = scale(df, ["a", "b"]).collect()
    assert got[3]["a"] == pytest.approx((10 - 7 / 3) / np.std([1, 2, 4])) and got[3]["b"] == 1.0
    assert scale(df, ["a", "b"]).columns == df.columns
    assert apply_scaler(df.drop("b"), fit_scaler(df, ["a", "b"])).columns == ["a", "split"]


def test_scaler_of_constant_and_empty_columns(spark):
    """A column of one value has the deviation 0 exactly, whatever the tasks; one without values has neither figure."""
    value = 0.1 + 1e-9
    df = spark.range(10_007).selectExpr(f"double({value}) AS a", "CAST(NULL AS double) AS b", "id AS c", "IF(id % 2 = 0, double('NaN'), 1e9 + id) AS d")
    got = {r["feature"]: (r["mean"], r["std"]) for r in fit_scaler(df.repartition(13), ["a", "b", "c", "d"]).collect()}
    assert got["a"] == (value, 0.0) and got["b"] == (None, None)
    ids = np.arange(10_007)
    assert got["c"] == pytest.approx((ids.mean(), ids.std()), rel=1e-12)
    assert got["d"] == pytest.approx((1e9 + ids[1::2].mean(), ids[1::2].std()), rel=1e-12)
    plan = fit_scaler(df, ["a", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "stddev" not in plan
