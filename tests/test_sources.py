"""Files, generator, series, payloads and streams."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from netloom.functions import seeded
from netloom.functions.instants import micros
from netloom.operators import series
from netloom.operators.scale import fit_scaler
from netloom.plans import sizing, workflows
from netloom.schema import ATTACK_CLASSES, FLOW_SCHEMA, ID_COLS, MODEL_FEATURES
from netloom.sources import flow_files, generate
from netloom.sources.tables import flow_counters
from netloom.streaming import flow_stream


@pytest.fixture(scope="module")
def made(spark):
    return sizing.durable(generate.generate(spark, 3000, seed=7), "test-flows")


def test_generator_invariants(made):
    assert made.columns == ["id", *FLOW_SCHEMA.names] and made.count() == 3000
    broken = made.filter(
        """FLOW_END_MILLISECONDS <= FLOW_START_MILLISECONDS
        OR DURATION_IN + DURATION_OUT > FLOW_DURATION_MILLISECONDS OR DURATION_IN < 0
        OR SRC_TO_DST_IAT_AVG NOT BETWEEN SRC_TO_DST_IAT_MIN AND SRC_TO_DST_IAT_MAX
        OR DST_TO_SRC_IAT_AVG NOT BETWEEN DST_TO_SRC_IAT_MIN AND DST_TO_SRC_IAT_MAX
        OR MIN_IP_PKT_LEN > MAX_IP_PKT_LEN OR (Attack = 'Normal') <> (Label = 0)
        OR NUM_PKTS_UP_TO_128_BYTES + NUM_PKTS_128_TO_256_BYTES + NUM_PKTS_256_TO_512_BYTES
           + NUM_PKTS_512_TO_1024_BYTES + NUM_PKTS_1024_TO_1514_BYTES > IN_PKTS + OUT_PKTS"""
    )
    assert broken.count() == 0
    starts = [r[0] for r in made.orderBy("id").select("FLOW_START_MILLISECONDS").collect()]
    assert starts == sorted(starts) and starts[-1] <= generate.DEFAULT_BASE_MS
    row = made.agg(
        F.avg("IN_PKTS"), F.avg("OUT_PKTS"), F.avg("Label"), F.avg(F.ln(F.col("IN_BYTES") + 1.0)),
        F.avg("RETRANSMITTED_IN_PKTS"), F.collect_set("Attack"),
    ).first()
    assert row[0] == pytest.approx(20, abs=0.5) and row[1] == pytest.approx(15, abs=0.5)
    assert row[2] == pytest.approx(0.3, abs=0.05) and row[3] == pytest.approx(10, abs=0.2)
    assert row[4] == pytest.approx(1, abs=0.1) and set(row[5]) == set(ATTACK_CLASSES)


def test_generator_ignores_partitioning(spark, made):
    again = generate.generate_flows(spark.range(0, 3000, 1, 13), "id", seed=7)
    assert again.exceptAll(made).count() == 0
    assert generate.generate(spark, 3000, seed=8).exceptAll(made).count() > 2900


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_round_trip(spark, made, tmp_path, kind):
    path = f"{tmp_path}/DatasetType.flows"
    stored = f"{tmp_path}/flows"
    plain = made.drop("id")
    flow_files.save_table(plain, stored, kind)
    back = flow_files.load_flows(spark, path, kind.upper(), partitions=3)
    assert back.schema == FLOW_SCHEMA and back.rdd.getNumPartitions() == 3
    assert back.exceptAll(plain).count() == 0 and back.count() == 3000


def test_loader_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        flow_files.load_flows(spark, str(tmp_path), "json")
    with pytest.raises(AnalysisException):
        flow_files.load_flows(spark, f"{tmp_path}/absent", "parquet")
    with pytest.raises(ValueError):
        flow_files.save_table(spark.range(1), f"{tmp_path}/x", "orc")


def test_names_and_paths():
    assert flow_files.clean_path("/a/DatasetType.b.csv") == "/a/b.csv"
    assert flow_files.clean_path("DatasetType.b.csv") == "b.csv"
    assert flow_files.clean_path("/DatasetType.a/b.csv") == "/DatasetType.a/b.csv"
    assert flow_files.resampled_name("x.y.csv") == "x.y-smote.csv"
    assert flow_files.resampled_name("x.csv", False) == "x.csv"


def test_save_resampled_single_file(spark, made, tmp_path):
    with pytest.warns(UserWarning):
        path = flow_files.save_resampled(made, str(tmp_path), "flows.csv", single_file=True)
    assert path.endswith("flows-smote.csv") and len(spark.read.csv(path).inputFiles()) == 1


def test_dictionary(spark, tmp_path):
    file = tmp_path / "d.csv"
    file.write_text("﻿Feature,Description\nIN_BYTES   ,Incoming bytes\n", encoding="utf-8")
    rows = flow_files.load_dictionary(spark, str(file))
    assert rows.columns == ["Feature", "Description"] and rows.first()["Feature"] == "IN_BYTES"


def test_load_profile(made):
    rows = {r["feature"]: r for r in flow_files.load_profile(made.select("IN_PKTS"), approx=False).collect()}
    assert rows["IN_PKTS"]["count"] == 3000 and flow_files.sample_rows(made).count() == 5


def test_interarrival(spark):
    rows = [("a", t) for t in (0.0, 0.5, 2.0, 2.1)] + [("b", 1.0), ("c", 1.0), ("c", 4.0)]
    rows += [("d", t) for t in (5.0, 5.0, 5.0, 7.0)] + [("e", t) for t in (0.0, 1.0, 2.0, 3.0)]
    rows += [(None, t) for t in (0.0, 10.0, 30.0)]
    df = spark.createDataFrame(rows, "k string, t double").repartition(4)
    for width in (0.3, 2.0, 100.0):
        got = {r["k"]: r for r in series.interarrival(df, ["k"], "t", width=width).collect()}
        assert got["a"]["gap_std"] == pytest.approx(0.7211102551) and got["a"]["gap_cv"] == pytest.approx(1.0301575073)
        assert got["b"]["gap_std"] is None and got["b"]["events"] == 1
        assert got["c"]["gap_std"] == 0 and got["c"]["gap_mean"] == 3
        assert got["d"]["gap_std"] == pytest.approx(np.std([1e-9, 1e-9, 2], ddof=1))
        assert got["e"]["gap_std"] == pytest.approx(0, abs=1e-12)
        assert got[None]["gap_std"] == pytest.approx(np.std([10, 20], ddof=1))
    with pytest.raises(Exception, match="two timestamps"):
        series.interarrival(df, ["k"], "t", strict=True).collect()


def test_interarrival_hot_key(spark):
    rng = np.random.default_rng(6)
    times = np.sort(rng.integers(0, 10**9, 4000))
    rows = [("hot", int(t)) for t in times] + [(f"k{i}", int(t)) for i, t in enumerate(times[::2])]
    df = spark.createDataFrame(rows, "k string, t bigint").repartition(8)
    gaps = np.diff(times) / 1e6
    gaps[gaps == 0] = 1e-9
    for hot_rows in (100_000, 1000):
        result = series.interarrival(df, ["k"], "t", unit=1e6, width=10**7, hot_rows=hot_rows)
        got = result.filter("k = 'hot'").first()
        assert got["gap_std"] == pytest.approx(np.std(gaps, ddof=1)) and got["gap_mean"] == pytest.approx(gaps.mean())
        assert result.filter("events = 1 AND gap_std IS NULL").count() == 2000


def test_ranges_of_a_hot_key(spark):
    """A burst inside one unit of width is spread over ranges that keep the order of time."""
    rng = np.random.default_rng(7)
    times = np.unique(np.concatenate([rng.integers(0, 10**6, 9000), rng.integers(0, 10**12, 1000)]))
    df = spark.createDataFrame([(None, int(t)) for t in times], "k string, _at bigint").repartition(8)
    rows = series._with_ranges(df, ["k"], 3_600_000_000, 1000).orderBy("_at").collect()
    ranges = [r["_range"] for r in rows]
    assert ranges == sorted(ranges) and max(np.unique(ranges, return_counts=True)[1]) <= 200


def test_time_order(spark):
    rows = [("a", 1, 10), ("a", 2, 10), ("a", 30, 11), ("b", 1, 10), ("b", 25, 9), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "k string, n int, t int")
    got = {r["k"]: r["in_order"] for r in series.in_time_order(df, ["k"], "n", "t", width=10).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_byte_entropy(spark):
    rows = [(1, "aaaa"), (2, "ab"), (3, ""), (4, None), (5, "é"), (2, "b" * 6)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(3)
    got = sorted((r["k"], r["e"]) for r in df.filter("k <> 2").select("k", series.byte_entropy("s").alias("e")).collect())
    assert got == [(1, 0.0), (3, None), (4, None), (5, 1.0)]
    by = {r["k"]: r for r in series.byte_entropy_by(df, ["k"], "s").collect()}
    assert by[2]["bytes"] == 8 and by[2]["entropy"] == pytest.approx(-(1 / 8) * np.log2(1 / 8) - (7 / 8) * np.log2(7 / 8))
    assert by[1]["entropy"] == 0.0 and set(by) == {1, 2, 3, 4, 5}
    assert all(by[k]["bytes"] == 0 and by[k]["entropy"] is None for k in (3, 4))
    binary = df.select(F.encode("s", "UTF-8").alias("s"), "k")
    assert {r["k"]: r["bytes"] for r in series.byte_entropy_by(binary, ["k"], "s").collect()} == {1: 4, 2: 8, 3: 0, 4: 0, 5: 2}
    assert series.byte_entropy_by(df.limit(0), ["k"], "s").count() == 0


def test_byte_values_are_counted_over_strip_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 3, 700, 0, 1, 5000, 0)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    group = np.array([2, 0, 1, 1, 2, 0, 3])
    monkeypatch.setattr(series, "STRIP_BYTES", 64)
    got = series._value_counts(starts, np.concatenate(rows), group, 4)
    want = [np.bincount(np.concatenate([r for r, g in zip(rows, group) if g == k]), minlength=256) for k in range(4)]
    assert (got == np.array(want)).all()


def test_entropy_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", "ab"), ("2024-01-01 00:50:00", "a", "ab"), ("2024-01-01 01:00:00", "a", ""),
            ("2024-01-01 01:10:00", "b", None), (None, "a", "zz"), ("2024-01-01 01:20:00", None, "cc")]
    df = spark.createDataFrame(rows, "t string, k string, s string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = flow_stream.entropy_windows(df, ["k"], "t", "s").collect()
    hour, first = 3_600_000_000, 1_704_067_200_000_000
    assert {((r["window_us"] - first) // hour, r["k"], r["bytes"], r["entropy"]) for r in got} == {
        (0, "a", 4, 1.0), (1, "a", 0, None), (1, "b", 0, None), (1, None, 2, 0.0)}


def test_micros(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:15.123456' AS a, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS b")
    assert df.select(micros(df, "a"), micros(df, "b")).first() == (1711852215123456, -500000)


def test_windows_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(12)
    us = np.sort(rng.integers(0, 4 * 3_600_000_000, 1500))
    us[10:20] = us[10]
    rows = [(int(t), int(k)) for t, k in zip(us, rng.integers(0, 3, 1500))]
    events = spark.createDataFrame(rows, "us bigint, k int").select("k", F.timestamp_micros("us").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flow_stream.read_stream(spark, f"{tmp_path}/in", events.schema)
    live = flow_stream.run_available(flow_stream.interarrival_windows(stream, ["k"], "ts"), "w").collect()
    batch = flow_stream.interarrival_windows(events, ["k"], "ts").collect()
    closed = [r for r in batch if r["window_us"] + 3_600_000_000 <= max(us) - 600_000_000]
    key = lambda r: (r["window_us"], r["k"])
    assert sorted(map(tuple, live)) == sorted(map(tuple, closed)) and closed
    for r in batch:
        mine = sorted(t for t, k in rows if k == r["k"] and r["window_us"] <= t < r["window_us"] + 3_600_000_000)
        gaps = np.diff(mine) / 1e6
        gaps[gaps == 0] = 1e-9
        assert r["events"] == len(mine) and r["gap_std"] == pytest.approx(np.std(gaps, ddof=1)), key(r)


def test_feature_stream_equals_batch(spark, made, tmp_path):
    made.repartition(3).write.parquet(f"{tmp_path}/in")
    stats = fit_scaler(made, MODEL_FEATURES)
    stream = flow_stream.read_stream(spark, f"{tmp_path}/in", made.schema, files_per_trigger=1)
    live = flow_stream.run_available(flow_stream.stream_features(stream, stats), "f")
    assert live.exceptAll(flow_stream.stream_features(made, stats)).count() == 0 and live.count() == 3000


def test_workflows(spark, made):
    balanced = workflows.rebalance(made, "id", k=3, ratio=0.5)
    counts = {r[0]: r[1] for r in balanced.groupBy("Label").count().collect()}
    before = {r[0]: r[1] for r in made.groupBy("Label").count().collect()}
    assert counts[0] == before[0] and counts[1] == before[1] + int((before[0] - before[1]) * 0.5)
    assert not set(ID_COLS) & set(balanced.columns)
    scaled = workflows.engineer(balanced, "id")
    assert scaled.count() == balanced.count()
    assert {"packet_entropy", "timing_variance", "quantum_noise_simulation", "split"} <= set(scaled.columns)
    with pytest.raises(ValueError):
        workflows.engineer(made, "id", features_on="both")


def test_hot_flow(spark):
    """One flow holds a third of all packets."""
    rng = np.random.default_rng(9)
    n = 3000
    flow = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 200, n))
    times, sizes = rng.integers(0, 400, n), rng.integers(30, 1500, n)
    inbound, lost = rng.random(n) < 0.5, rng.random(n) < 0.1
    rows = [
        (int(f), bool(i), int(t), int(z), bool(r), 1)
        for f, i, t, z, r in zip(flow, inbound, times, sizes, lost)
    ]
    schema = "flow_id bigint, inbound boolean, t bigint, length bigint, retransmitted boolean, peer bigint"
    got = {r["flow_id"]: r for r in flow_counters(spark.createDataFrame(rows, schema).repartition(8)).collect()}
    assert len(got) == len(set(flow))
    for key, r in got.items():
        for side, tag in ((True, "in"), (False, "out")):
            mine = (flow == key) & (inbound == side)
            gaps = np.diff(np.sort(times[mine]))
            assert r[f"{tag}_pkts"] == mine.sum() and r[f"{tag}_bytes"] == sizes[mine].sum()
            assert r[f"{tag}_re_pkts"] == (mine & lost).sum()
            assert r[f"{tag}_gap_min"] == (gaps.min() if len(gaps) else 0)
            assert r[f"{tag}_gap_max"] == (gaps.max() if len(gaps) else 0)
            assert r[f"{tag}_gap_squares"] == (gaps**2).sum()


def test_start_times_over_levels(spark, monkeypatch):
    """Sums over ranges of ranges equal a plain running sum."""
    ids = spark.range(3, 700, 2)
    plain = {r["id"]: r[1] for r in generate.start_times(ids, "id", 42, 10**12).collect()}
    monkeypatch.setattr(generate, "_RANGE", 4)
    assert {r["id"]: r[1] for r in generate.start_times(ids, "id", 42, 10**12).collect()} == plain


def test_draws_are_uniform(spark):
    """The draws of a row: each uniform, pairs without correlation."""
    tags = ["a", "b", "label", "size0.1"]
    x, y = seeded.row_state(1, "id")
    rows = spark.range(20_000).withColumns({"x": x, "y": y}).select(seeded.uniforms(tags, "x", "y").alias("u"))
    draws = np.array([r["u"] for r in rows.collect()])
    assert draws.min() >= 0 and draws.max() < 1
    for column in draws.T:
        assert np.abs(np.bincount((column * 20).astype(int), minlength=20) - 1000).max() < 150
    assert np.abs(np.corrcoef(draws.T) - np.eye(4)).max() < 0.03
    assert np.abs(np.corrcoef(np.abs(draws.T - 0.5)) - np.eye(4)).max() < 0.03


def test_join_small_falls_back(spark):
    big = spark.range(100).withColumn("k", F.when(F.col("id") < 90, F.col("id") % 7))
    small = spark.createDataFrame([(i, i * 10) for i in range(7)] + [(None, -1)], "k bigint, v bigint")
    quick = sizing.join_small(big, small, ["k"]).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    slow = sizing.join_small(big, small, ["k"]).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, quick), key=str) == sorted(map(tuple, slow), key=str) and len(quick) == 100


def test_flow_partitions_grow_with_the_packets(spark, monkeypatch):
    """A task's share of the combined packets is bounded; before, partitions did not follow the size of the table."""
    from netloom.sources import tables

    monkeypatch.setattr(tables, "PART_BYTES", 4096)
    counters = tables.flow_counters(tables.packets(spark, "/root/testdata/sf0.001"))
    assert counters.rdd.getNumPartitions() > 8
    assert counters.count() == counters.select("flow_id").distinct().count()


def test_one_digest_for_all_draws(spark):
    """A row's digest is taken once, not once per tag, however Spark merges projections."""
    x, y = seeded.row_state(1, "id")
    rows = spark.range(10).withColumns({"x": x, "y": y}).select(seeded.uniforms(["a", "b"], "x", "y").alias("u"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.rindex("lambdafunction((") :].split(", lambda")[0]
    assert "md5" in plan and "md5" not in inner


def test_generation_is_spread(spark):
    """Narrow rows become wide ones in several tasks, though Spark would put them into one."""
    assert generate.generate(spark, 20 * 8192).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_stream_batch_is_spread(spark, tmp_path):
    """A batch of one file is dealt to the asked number of tasks; rows stay the same."""
    made = generate.generate(spark, 500, seed=3)
    made.coalesce(1).write.parquet(str(tmp_path / "arriving"))
    stream = flow_stream.read_stream(spark, str(tmp_path / "arriving"), made.schema)
    out = flow_stream.run_available(flow_stream.stream_features(stream, partitions=4).select("id"), "spread")
    assert len(out.inputFiles()) == 4
    assert sorted(r["id"] for r in out.collect()) == list(range(500))


def test_load_into_fewer_partitions_exchanges_no_rows(spark, tmp_path):
    """Splits are put together where there are enough of them, and rows are dealt out otherwise."""
    made = generate.generate(spark, 400, seed=5)
    made.repartition(8).write.parquet(str(tmp_path / "many"))
    made.coalesce(1).write.parquet(str(tmp_path / "one"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = flow_files.load_flows(spark, str(tmp_path / "many"), "parquet", partitions=3)
    assert few.rdd.getNumPartitions() == 3 and few.count() == 400 and "Exchange" not in plan(few)
    more = flow_files.load_flows(spark, str(tmp_path / "one"), "parquet", partitions=6)
    assert more.rdd.getNumPartitions() == 6 and more.count() == 400


def test_no_task_combines_a_whole_split(spark):
    """Packets leave their input split as they are: what a task combines follows the partitions, not the split."""
    schema = "flow_id bigint, inbound boolean, t bigint, length bigint, retransmitted boolean, peer bigint"
    packets = spark.createDataFrame([(1, True, 2, 30, False, 1), (1, True, 2, 40, True, 1)] * 50, schema).repartition(40)
    counters = flow_counters(packets)
    plan = counters._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.rindex("Exchange") :] and "Aggregate" in plan
    row = counters.first()
    assert (row["in_pkts"], row["in_bytes"], row["in_re_pkts"], row["in_gap_min"]) == (100, 3500, 50, 0)
