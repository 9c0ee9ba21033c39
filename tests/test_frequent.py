"""Most frequent values against counting every value."""

from collections import Counter

import numpy as np
import pytest

from netloom.operators import frequent
from netloom.streaming import flow_stream, frequent_stream


def brute(values, k):
    order = sorted(Counter(values).items(), key=lambda t: (-t[1], t[0] is not None, t[0] or ""))
    return order[:k]


def frame(spark, values, parts=6):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)


def found(df):
    return [tuple(r) for r in df.collect()]


def skewed():
    rng = np.random.default_rng(5)
    return [f"h{i}" for i in np.minimum(rng.zipf(1.3, 20000), 10**7)] + ["hot"] * 12000 + [None] * 300 + [f"u{i}" for i in range(9000)]


@pytest.mark.parametrize("k", [1, 10, 100])
def test_equals_full_counts(spark, k):
    values = skewed()
    assert found(frequent.top_values(frame(spark, values), "v", k)) == brute(values, k)


def test_level_counts_and_a_blind_sketch(spark):
    """No candidate stands out, or the sketch is far too small: the buckets still decide."""
    level = [f"v{i % 3000}" for i in range(12000)]
    assert found(frequent.top_values(frame(spark, level), "v", 20)) == brute(level, 20)
    values = skewed()
    assert found(frequent.top_values(frame(spark, values), "v", 8, tracked=8)) == brute(values, 8)


def test_few_values_nulls_and_empty(spark):
    assert found(frequent.top_values(frame(spark, ["b", "a", None, None]), "v", 5)) == [(None, 2), ("a", 1), ("b", 1)]
    assert found(frequent.top_values(frame(spark, [None, None]), "v", 5)) == [(None, 2)]
    assert found(frequent.top_values(frame(spark, []), "v", 5)) == []
    with pytest.raises(ValueError):
        frequent.top_values(frame(spark, ["a"]), "v", 0)


def test_other_columns_and_numbers(spark):
    df = spark.range(5000).selectExpr("id % 7 + floor(id / 4000) AS `a.b`", "id AS n", "id AS hash")
    want = Counter(r[0] for r in df.select("`a.b`").collect())
    got = dict(found(frequent.top_values(df, "a.b", 3)))
    assert got == dict(sorted(want.items(), key=lambda t: (-t[1], t[0]))[:3])


def test_stream_counts_a_replayed_batch_once(spark, tmp_path):
    values = skewed()
    df, folder, store = frame(spark, values), str(tmp_path / "in"), str(tmp_path / "store")
    df.write.parquet(folder)
    stream = flow_stream.read_stream(spark, folder, df.schema, files_per_trigger=2)
    frequent_stream.run_summaries(stream, "v", store, str(tmp_path / "progress"))
    summary = frequent.stored_summary(spark, store)
    assert summary[1].where("hash = 0").agg({"n": "sum"}).first()[0] == len(values)
    assert found(frequent.top_values(df, "v", 25, summary=summary)) == brute(values, 25)
    first = spark.read.parquet(folder).limit(10)
    step = frequent_stream.summarise_batches("v", store)
    step(first, 99)
    step(first, 99)
    assert frequent.stored_summary(spark, store)[1].where("hash = 1").agg({"n": "sum"}).first()[0] == len(values) + 10
