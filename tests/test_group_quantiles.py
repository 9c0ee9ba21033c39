"""Exact quantiles of many groups against NumPy."""

import math

import numpy as np
import pytest

from netloom.operators.group_quantiles import grouped_quantiles, impute_by_group

PROBS = [0.0, 0.1, 0.5, 0.99, 1.0]


def found(df, keys, columns, probs):
    rows = grouped_quantiles(df, keys, columns, probs).collect()
    return {(*[r[k] for k in keys], r["feature"], r["prob"]): (r["n"], r["value"]) for r in rows}


def test_many_groups_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = rng.zipf(1.6, 3000).clip(max=60)
    values = np.round(rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), 6)
    values[::7] = np.round(values[::7])  # ties and both zeros
    whole = rng.integers(-(2**40), 2**40, 3000)
    df = spark.createDataFrame([(int(g), "x", float(v), int(w)) for g, v, w in zip(groups, values, whole)],
                               "g int, kind string, v double, w bigint")
    got = found(df.repartition(6), ["g", "kind"], ["v", "w"], PROBS)
    assert len(got) == len(set(groups)) * 2 * len(PROBS)
    for (g, _, column, p), (n, value) in got.items():
        own = (values if column == "v" else whole)[groups == g]
        assert n == len(own) and value == pytest.approx(np.quantile(own.astype(float), p), rel=1e-12, abs=1e-300)


def test_odd_values_and_empty_groups(spark):
    inf, nan = math.inf, math.nan
    rows = [(None, 1.0), (None, 3.0), ("a", nan), ("a", None), ("b", -inf), ("b", 2.0), ("b", inf), ("c", -0.0), ("c", 0.0),
            ("d", 5e-324), ("d", -5e-324), ("d", 1.0)]
    df = spark.createDataFrame(rows, "k string, n double")
    got = found(df, ["k"], ["n"], [0.0, 0.5, 1.0])
    assert got[None, "n", 0.5] == (2, 2.0) and not any(k[0] == "a" for k in got)
    assert [got["b", "n", p][1] for p in (0.0, 0.5, 1.0)] == [-inf, 2.0, inf]
    assert got["c", "n", 0.5] == (2, 0.0) and got["d", "n", 0.0] == (3, -5e-324) and got["d", "n", 0.5] == (3, 5e-324)
    assert found(df.limit(0), ["k"], ["n"], [0.5]) == {}
    assert found(df, [], ["n"], [0.5])["n", 0.5][0] == 10
    with pytest.raises(ValueError):
        grouped_quantiles(df, ["k"], ["n"], [1.5])


def test_hot_group(spark):
    df = spark.range(60_000).selectExpr("CASE WHEN id % 3 < 2 THEN 0 ELSE id END AS g", "cast(id % 977 as double) / 7 AS v")
    got = found(df, ["g"], ["v"], [0.25])
    hot = np.array([(i % 977) / 7 for i in range(60_000) if i % 3 < 2])
    assert got[0, "v", 0.25] == (40_000, pytest.approx(np.quantile(hot, 0.25))) and len(got) == 20_001


def test_impute_by_group(spark):
    nan = math.nan
    rows = [(1, "a", 1.0, 1.0), (2, "a", nan, 2.0), (3, "a", 5.0, None), (4, "b", None, math.inf), (5, None, None, 7.0), (6, None, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, k string, x double, y double")
    out = {r["id"]: (r["x"], r["y"]) for r in impute_by_group(df, ["k"], ["x", "y"]).collect()}
    assert out == {1: (1.0, 1.0), 2: (3.0, 2.0), 3: (5.0, 1.5), 4: (None, None), 5: (4.0, 7.0), 6: (4.0, 9.0)}
    assert impute_by_group(df, ["k"], ["x"], "mean").columns == df.columns
    with pytest.raises(ValueError):
        impute_by_group(df, ["k"], ["x"], "mode")
