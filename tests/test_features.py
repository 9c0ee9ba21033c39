"""Row features and channels against NumPy and worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import channels as ch
from netloom.functions import features as ft
from netloom.functions.address import ip_to_int
from netloom.operators.states import channel_sweep, default_state, state_validity
from netloom.schema import BYTES_FEATURES, FLOW_SCHEMA, MODEL_FEATURES, NOISE_FEATURES

NAN, INF = float("nan"), float("inf")


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


def test_schema():
    kinds = [f.dataType.simpleString() for f in FLOW_SCHEMA.fields]
    assert (kinds.count("bigint"), kinds.count("double"), kinds.count("string")) == (49, 3, 3)
    assert len(MODEL_FEATURES) == 49 and len(BYTES_FEATURES) == 15 and len(NOISE_FEATURES) == 18


@pytest.mark.parametrize(
    "value, byte",
    [(300.7, 44), (-0.5, 0), (-1.3, 255), (255.9, 255), (256.0, 0), (1.7e12 + 5, 0), (2147483647.0, 255),
     (2147483655.0, 0), (INF, 0), (-INF, 0)],
)
def test_byte_cast(spark, value, byte):
    assert one(spark, ft._to_byte(F.col("x")), x=value) == byte


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 1], [1, 2], [5], [3, 3, 3, 7, 7, 9], list(range(15))])
def test_multiset_entropy(spark, values):
    _, counts = np.unique(values, return_counts=True)
    share = counts / len(values)
    column = ft.multiset_entropy(F.sort_array(F.array(*[F.lit(v) for v in values])), len(values))
    assert one(spark, column) == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-12)


def test_packet_entropy_missing(spark):
    # Two known bytes, one NaN and one NULL are skipped or kept as documented.
    df = spark.createDataFrame([(1.0, NAN, None, 1.0)], "a double, b double, c double, d double")
    assert df.select(ft.packet_entropy(df, ["a", "b", "c", "d"])).first()[0] == 0.0
    # An absent column counts as zero: bytes 1, 1, 0.
    wanted = -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)
    assert df.select(ft.packet_entropy(df, ["a", "d", "absent"])).first()[0] == pytest.approx(wanted)
    empty = spark.createDataFrame([(NAN,)], "a double")
    assert empty.select(ft.packet_entropy(empty, ["a"])).first()[0] == 0.0


@pytest.mark.parametrize(
    "times, std, cv",
    [([0, 1, 2, 3], 0, 0), ([0, 0.5, 2, 2.1], 0.7211102551, 1.0301575073), ([1, 4], 0, 0)],
)
def test_gap_variation(spark, times, std, cv):
    column = F.array(*[F.lit(float(t)) for t in times])
    assert one(spark, ft.gap_variation(column, False)) == pytest.approx(std, abs=1e-9)
    assert one(spark, ft.gap_variation(column, True)) == pytest.approx(cv, abs=1e-9)


def test_timing_variance_edges(spark):
    df = spark.createDataFrame([(5.0, NAN, None)], "a double, b double, c double")
    assert df.select(ft.timing_variance(df, ["a", "b", "c"])).first()[0] == 0.0
    df = spark.createDataFrame([(2.0, 2.0, 2.0)], "a double, b double, c double")
    assert df.select(ft.timing_variance(df, ["a", "b", "c"])).first()[0] == pytest.approx(0.0)


def noise_by_hand(row):
    """Flip probability and entropy from the published definitions, with dense matrices."""
    v = lambda c: max(0.0, row[c]) if row.get(c) is not None and not math.isnan(row[c]) else 0.0
    total = v("IN_BYTES") + v("OUT_BYTES")
    q = v("IN_BYTES") / total if total > 0 else 0.5
    retrans = (
        v("RETRANSMITTED_IN_PKTS") / max(1.0, v("IN_PKTS"))
        + v("RETRANSMITTED_OUT_PKTS") / max(1.0, v("OUT_PKTS"))
    ) / 2
    iat = 0.1 * min(1.0, (v("SRC_TO_DST_IAT_STDDEV") + v("DST_TO_SRC_IAT_STDDEV")) / 2000)
    lost = (v("RETRANSMITTED_IN_BYTES") + v("RETRANSMITTED_OUT_BYTES")) / total if total > 0 else 0.0
    mean = lambda k: (v(f"SRC_TO_DST_{k}") + v(f"DST_TO_SRC_{k}")) / 2
    top, mid, low, rate = mean("IAT_MAX"), mean("IAT_AVG"), mean("IAT_MIN"), mean("SECOND_BYTES")
    if mid > 0:
        burst = min(0.25, (top / mid - 1) / 10) if top / mid > 1 else 0.0
    else:
        burst = min(0.25, top / 10000) if top > 0 else 0.0
    spread = min(0.05, (top - low) / top * 0.1) if top > 0 else 0.0
    slow = min(0.05, max(0.0, (1000 - rate) / 10000)) if rate > 0 else 0.05
    p = 0.5 * retrans + 0.2 * iat + 0.2 * lost + 0.1 * min(0.3, burst + slow + spread)
    p = max(0.001, min(1.0, max(0.0, p)))
    ket = np.array([[math.sqrt(q)], [math.sqrt(1 - q)]])
    rho = ket @ ket.T
    flips = [np.array([[0, 1], [1, 0]]), np.array([[1, 0], [0, -1]])]
    entropies = []
    for flip in flips:
        eigen = np.linalg.eigvalsh((1 - p) * rho + p * flip @ rho @ flip)
        eigen = eigen[eigen > 1e-15]
        entropies.append(-(eigen * np.log2(eigen)).sum())
    return p, sum(entropies) / 2


def test_noise_every_branch(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        row = {c: float(rng.integers(0, 2000)) for c in NOISE_FEATURES}
        if i % 7 == 0:  # no bytes at all
            row["IN_BYTES"] = row["OUT_BYTES"] = 0.0
        if i % 5 == 0:  # no rate
            row["SRC_TO_DST_SECOND_BYTES"] = row["DST_TO_SRC_SECOND_BYTES"] = 0.0
        if i % 3 == 0:  # maximum without average
            row["SRC_TO_DST_IAT_AVG"] = row["DST_TO_SRC_IAT_AVG"] = 0.0
        if i % 11 == 0:
            row["SRC_TO_DST_IAT_MAX"] = row["DST_TO_SRC_IAT_MAX"] = 0.0
        if i % 4 == 0:  # negative inputs count as zero, minimum above maximum is kept
            row["SRC_TO_DST_IAT_STDDEV"] = -3.0
        if i % 13 == 0:
            row["OUT_PKTS"] = NAN
        if i % 17 == 0:
            row["RETRANSMITTED_IN_PKTS"] = None
        rows.append(row)
    schema = ", ".join(f"{c} double" for c in NOISE_FEATURES)
    df = spark.createDataFrame([tuple(r[c] for c in NOISE_FEATURES) for r in rows], schema).coalesce(1)
    got = ft.add_noise_entropy(ft.add_noise_components(df)).select("p", "quantum_noise_simulation").collect()
    for (p, entropy), row in zip(got, rows):
        wanted = noise_by_hand(row)
        assert p == pytest.approx(wanted[0], abs=1e-12)
        assert entropy == pytest.approx(wanted[1], abs=1e-9)


def test_noise_without_columns(spark):
    df = spark.createDataFrame([(10.0,)], "IN_BYTES double")
    got = ft.add_noise_entropy(ft.add_noise_components(df)).first()
    p, entropy = noise_by_hand({"IN_BYTES": 10.0})
    assert got["p"] == pytest.approx(p) and got["quantum_noise_simulation"] == pytest.approx(entropy, abs=1e-9)


def test_channels_against_matrices(spark):
    rng = np.random.default_rng(3)
    cases = []
    for i in range(300):
        q = float(rng.random())
        cases.append((i, q, float(rng.uniform(-1, 1)) * math.sqrt(q * (1 - q))))
    grid = [0.0, 0.13, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(cases, "id int, q double, c double")
    flips = {"bit": np.array([[0, 1], [1, 0]]), "phase": np.array([[1, 0], [0, -1]])}
    rows = channel_sweep(df, "id", grid).collect()
    assert len(rows) == 300 * 5 * 2
    for r in rows:
        rho = np.array([[r["q"], r["c"]], [r["c"], 1 - r["q"]]])
        flip = flips[r["channel"]]
        noisy = (1 - r["p"]) * rho + r["p"] * flip @ rho @ flip
        assert np.allclose([[r["r00"], r["r01"]], [r["r01"], r["r11"]]], noisy, atol=1e-12)
        eigen = np.linalg.eigvalsh(noisy)
        eigen = eigen[eigen > 1e-15]
        assert r["entropy"] == pytest.approx(-(eigen * np.log2(eigen)).sum(), abs=1e-9)
        assert r["purity"] == pytest.approx(np.trace(noisy @ noisy), abs=1e-12)
        values, vectors = np.linalg.eigh(rho)
        root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
        inner = np.clip(np.linalg.eigvalsh(root @ noisy @ root), 0, None)
        assert r["fidelity"] == pytest.approx(np.sqrt(inner).sum(), abs=1e-6)


def test_fixed_states(spark):
    plus = channel_sweep(default_state(spark.range(1)), "id", names=("bit",)).collect()
    assert len(plus) == 11
    for r in plus:
        assert (r["fidelity"], r["purity"], r["entropy"]) == pytest.approx((1, 1, 0))
    zero = channel_sweep(spark.range(1).withColumn("q", F.lit(1.0)), "id", names=("phase",)).collect()
    for r in zero:
        assert (r["fidelity"], r["purity"], r["entropy"]) == pytest.approx((1, 1, 0))
    with pytest.raises(ValueError):
        channel_sweep(default_state(spark.range(1)), "id", [0.5, 1.2])
    grid = spark.createDataFrame([(0.1,), (0.4,)], "p double")
    assert channel_sweep(default_state(spark.range(3)), "id", grid).count() == 12


def test_maximally_mixed(spark):
    half = F.lit(0.5)
    assert one(spark, ch.matrix_entropy(half, F.lit(0.0), half)) == pytest.approx(1)
    assert one(spark, ch.matrix_entropy(half, F.lit(0.0), half, math.e)) == pytest.approx(math.log(2))
    twice = F.lit(2.0)
    assert one(spark, ch.matrix_entropy(twice, F.lit(0.0), twice, normalize=True)) == pytest.approx(1)
    nothing = F.lit(0.0)
    assert one(spark, ch.matrix_entropy(nothing, nothing, nothing, normalize=True)) == 0


def test_state_validity(spark):
    rows = [(0.5, 0.5, 0.5, 0.5), (0.5, 0.1, 0.2, 0.5), (0.7, 0.0, 0.0, 0.7), (0.5, 0.9, 0.9, 0.5)]
    got = state_validity(spark.createDataFrame(rows, "r00 double, r01 double, r10 double, r11 double").coalesce(1))
    flags = [(r["hermitian"], r["unit_trace"], r["positive"]) for r in got.collect()]
    assert flags == [(True, True, True), (False, True, True), (True, False, True), (True, True, False)]


@pytest.mark.parametrize(
    "ip, number",
    [("192.168.1.10", 3232235786), ("0.0.0.0", 0), ("255.255.255.255", 4294967295), ("10.1", None),
     ("1.2.3.256", None), ("a.b.c.d", None), ("1.2.3.4.5", None), ("", None)],
)
def test_ip_to_int(spark, ip, number):
    assert one(spark, ip_to_int(F.col("x")), x=ip) == number


def test_row_features_are_not_interpreted(spark):
    """Array functions run row by row, value by value; the features of wide tables must not use them."""
    df = spark.createDataFrame([tuple(float(i) for i in range(len(MODEL_FEATURES)))], ", ".join(f"{c} double" for c in MODEL_FEATURES))
    plan = ft.add_engineered_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_row_features_keep_nan_and_infinity(spark):
    """NaN comes out of infinite inputs and is no missing value."""
    kinds = "a double, b double, c double"
    df = spark.createDataFrame([(0.0, INF, 1.0), (INF, INF, INF), (None, NAN, 3.0)], kinds).coalesce(1)
    timing = [r[0] for r in df.select(ft.timing_variance(df, ["a", "b", "c"])).collect()]
    assert math.isnan(timing[0]) and timing[1:] == [0.0, 0.0]
    assert [r[0] for r in df.select(ft.packet_entropy(df, ["a", "b", "c"])).collect()][1:] == [0.0, 0.0]
    df = spark.createDataFrame([(INF, 1.0), (1.0, INF)], "IN_BYTES double, OUT_BYTES double").coalesce(1)
    assert math.isnan(df.select(ft.quantum_noise_simulation(df)).first()[0])
    assert [r["q"] for r in ft.add_noise_components(df).collect()][1] == 0.0


def test_row_features_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0, 300, (500, len(MODEL_FEATURES)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"{c} double" for c in MODEL_FEATURES))
    made = ft.add_engineered_features(df)
    assert made.repartition(7).exceptAll(ft.add_engineered_features(df.repartition(31))).count() == 0
