"""Rebalancing, augmentation and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators.evaluate import roc_auc, security_level, threshold_metrics
from netloom.operators.resample import augment_gaussian, smote, synthetic_count
from netloom.operators.neighbors import knn

FEATURES = ["a", "b", "c"]


def classes(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label, n in sizes.items():
        for v in rng.normal(size=(n, 3)) + 5 * label:
            rows.append((i, *map(float, v), label))
            i += 1
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, Label bigint").repartition(6)


@pytest.mark.parametrize(
    "small, large, after",
    [(18225, 15863478, 7674464), (2600903, 17514626, 9807038), (91904, 2151027, 1086847)],
)
def test_published_counts(small, large, after):
    assert small + synthetic_count(small, large, 0.4831882086330935) == after


def test_rows_lie_between_their_parents(spark):
    df = classes(spark, {0: 60, 1: 25})
    out = smote(df, "id", FEATURES, k=4, ratio=0.8)
    made = out.filter("is_synthetic").collect()
    assert len(made) == int(35 * 0.8) and {r["Label"] for r in made} == {1}
    assert len({r["id"] for r in made}) == len(made) and all(r["id"] < 0 for r in made)
    assert out.filter("NOT is_synthetic").count() == 85
    minority = df.filter("Label = 1").select("id", F.array(*FEATURES).alias("vec"))
    points = {r["id"]: np.array(r["vec"]) for r in minority.collect()}
    near = [(points[r["id"]], points[r["neighbor_id"]]) for r in knn(minority, 4).collect()]
    for r in made:
        z = np.array([r[c] for c in FEATURES])
        gaps = []
        for x, y in near:
            t = np.clip(np.dot(z - x, y - x) / np.dot(y - x, y - x), 0, 1)
            gaps.append(np.linalg.norm(z - (x + t * (y - x))))
        assert min(gaps) < 1e-9


def test_same_result_for_any_partitioning(spark):
    df = classes(spark, {0: 40, 1: 15})
    rows = lambda d: sorted(tuple(r) for r in smote(d, "id", FEATURES, k=3).collect())
    assert rows(df.coalesce(1)) == rows(df.repartition(11))


def test_hot_copies_in_the_minority(spark):
    df = classes(spark, {0: 200, 1: 40})
    same_row = (F.col("Label") == 1) & (F.col("id") % 2 == 0)
    df = df.withColumns({c: F.when(same_row, 1.5).otherwise(F.col(c)) for c in FEATURES})
    plain = smote(df, "id", FEATURES, k=5)
    hubs = smote(df, "id", FEATURES, k=5, hot_draws=15)
    assert plain.filter("is_synthetic").count() == 160
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hubs.collect()))


def test_invalid_input(spark):
    three = classes(spark, {0: 10, 1: 10, 2: 10})
    one = classes(spark, {0: 10})
    few = classes(spark, {0: 30, 1: 4})
    for df in (three, one, few):
        with pytest.raises(ValueError):
            smote(df, "id", FEATURES, k=5)
        with pytest.warns(UserWarning):
            kept = smote(df, "id", FEATURES, k=5, on_invalid="skip")
        assert kept.count() == df.count() and kept.filter("is_synthetic").count() == 0
    balanced = classes(spark, {0: 4, 1: 4})
    assert smote(balanced, "id", FEATURES, k=5).count() == 8


def test_augment(spark):
    df = classes(spark, {0: 3000})
    out = augment_gaussian(df, "id", ["a"], 2.0)
    both = out.filter("is_augmented").select("id", F.col("a").alias("z")).join(df, "id")
    noise = np.array([r[0] for r in both.select((F.col("z") - F.col("a")) / 2).collect()])
    assert out.count() == 6000 and abs(noise.mean()) < 0.1 and abs(noise.std() - 1) < 0.1
    assert out.filter("is_augmented").select("b").distinct().count() == 3000


def test_auc_with_ties(spark):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, 400)
    score = np.round(rng.normal(size=400) + label, 1)
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(label, score)], "Label int, s double")
    got = roc_auc(df, "Label", "s").first()
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert roc_auc(df.filter("Label = 1"), "Label", "s").first()["auc"] is None


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.0), (1, 1.0)], "Label int, s double")
    got = threshold_metrics(df, "Label", "s").first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1)
    assert got["f1"] == pytest.approx(2 / 3)
    loss = -np.mean([np.log(0.9), np.log(0.2), np.log(0.2), np.log(1 - 1e-15), np.log(1 - 1e-15)])
    assert got["log_loss"] == pytest.approx(loss)


def test_security_level(spark):
    value = spark.range(1).select(security_level(F.lit(1.0), F.lit(2.0), F.lit(4.0))).first()[0]
    assert value == pytest.approx(0.6 + 0.5 + 0.6)


def test_rebalanced_table_that_is_read_once_is_not_written(spark, monkeypatch):
    from netloom.plans import workflows

    written, keep = [], workflows.durable
    monkeypatch.setattr(workflows, "durable", lambda table, name: (written.append(name), keep(table, name))[1])
    rows = [(i, "a", "b", float(i % 7), float(i), int(i < 12), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "flow_id long, IPV4_SRC_ADDR string, IPV4_DST_ADDR string, u double, v double, Label long, Attack string")
    once, twice = workflows.rebalance(df, "flow_id", k=3, stored=False), workflows.rebalance(df, "flow_id", k=3)
    assert written == ["clean", "clean", "balanced"]
    assert once.count() == 96 and once.exceptAll(twice).count() == 0


def test_steps_from_file_to_file_leave_their_files_only(spark):
    """What a step wrote to scratch is gone when its result is written, and CSV files are packed, none of them large."""
    from pathlib import Path

    from netloom.catalogue import join_queries
    from netloom.plans.sizing import checkpoint_root

    root = Path(checkpoint_root(spark).removeprefix("file:"), "netloom")
    before = set(root.iterdir()) if root.exists() else set()
    rows = join_queries.files_end_to_end(spark, "/root/testdata/sf0.001").count()
    made = {p.name.rpartition("-")[0]: p for p in set(root.iterdir()) - before}
    assert set(made) == {"raw-csv", "resampled", "engineered"}
    packed = [p for name in ("raw-csv", "resampled") for p in made[name].rglob("part-*")]
    assert packed and all(p.name.endswith(".csv.gz") for p in packed)
    again = spark.read.option("header", True).csv(str(made["resampled"]) + "/*")
    assert again.count() == rows


def test_a_step_keeps_the_tables_of_the_step_around_it(spark):
    from netloom.plans.sizing import durable, step

    with step():
        outer = durable(spark.range(7))
        with step():
            inner = durable(spark.range(3))
        assert outer.count() == 7
        with pytest.raises(Exception):
            spark.read.parquet(inner.inputFiles()[0])
