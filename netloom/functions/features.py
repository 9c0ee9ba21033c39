"""Row features of a flow record, as plain column expressions for batch or streaming tables.

The three features of a record, with their parts, are computed by NumPy for a batch of
rows at a time: Spark interprets array functions, which takes ten times as long, and
unrolled expressions exceed the JIT compiler's method-size limit on wide tables. The
operations keep Spark's rules for NaN: it is the largest value. A sum runs over the
columns in their order, so a row's result does not depend on its batch.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.channels import EPS
from netloom.schema import BYTES_FEATURES, NOISE_FEATURES, TIMING_FEATURES

_ZERO_GAP = 1e-9
_P_FLOOR = 0.001


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _known(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _sum(values: Column, term=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + term(v))


def _to_byte(v: Column) -> Column:
    """Truncate toward zero and wrap into 0..255; values from 2^31 on become 0."""
    return F.when(F.abs(v) < 2147483648.0, F.pmod(v.cast("int"), F.lit(256))).otherwise(0)


def multiset_entropy(values: Column, size: int) -> Column:
    """Shannon entropy in bits of a sorted array with at most ``size`` items.

    The j-th copy of a value adds j log2 j - (j-1) log2 (j-1); the sum over a run
    of c copies is c log2 c, and H = log2 n - (sum of c log2 c) / n.
    """
    weight = lambda c: c * math.log2(c) if c else 0.0
    steps = F.array(*[F.lit(weight(c) - weight(c - 1)) for c in range(1, size + 1)])
    copies = F.transform(
        values, lambda x, i: F.get(steps, (i + 1 - F.array_position(values, x)).cast("int"))
    )
    n = F.size(values)
    return F.when(n > 0, F.log2(n.cast("double")) - _sum(copies) / n).otherwise(0.0)


def _rows(*columns: pa.Array) -> list:
    """The values of each column, NaN for a missing one."""
    return [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]


def _byte_entropy(columns: list) -> np.ndarray:
    """Entropy of the known values of each row as bytes: the mean of -log2(c / n) over values that stand c times among n."""
    known = [~np.isnan(v) for v in columns]
    fits = [np.where(np.abs(v) < 2147483648.0, v, 0.0) for v in columns]
    # An unknown value gets a number of its own, equal to no byte.
    codes = [np.where(k, v.astype(np.int64) & 255, 256 + i).astype(np.int16) for i, (v, k) in enumerate(zip(fits, known))]
    copies = [np.ones(len(v), dtype=np.intp) for v in columns]
    for i in range(len(codes)):
        for j in range(i):
            same = codes[i] == codes[j]
            copies[i] += same
            copies[j] += same
    logs = np.log2(np.maximum(np.arange(len(columns) + 1), 1))
    n, shared = np.zeros(len(codes[0]), dtype=np.intp), np.zeros(len(codes[0]))
    for k, c in zip(known, copies):
        n += k
        shared += np.where(k, logs[c], 0.0)
    return np.maximum(logs[n] - shared / np.maximum(n, 1), 0.0)


def packet_entropy(df: DataFrame, columns=BYTES_FEATURES) -> Column:
    """Entropy of the byte features of a row, each taken as an unsigned byte.

    A column the table lacks counts as 0, a missing value is skipped, no value gives 0.
    """
    read = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(0.0)

    @F.arrow_udf("double")
    def entropy(*values: pa.Array) -> pa.Array:
        return pa.array(_byte_entropy(_rows(*values)))

    return entropy(*[read(c) for c in columns])


def gaps(times: Column) -> Column:
    """Gaps of a sorted array; equal neighbours are 1e-9 apart. NULL below two values."""
    n = F.size(times)
    gap = lambda late, early: F.when(late == early, F.lit(_ZERO_GAP)).otherwise(late - early)
    pairs = F.zip_with(F.slice(times, 2, n - 1), F.slice(times, 1, n - 1), gap)
    return F.when(n >= 2, pairs)


def gap_variation(times: Column, normalize: bool = True) -> Column:
    """Sample deviation (or coefficient of variation) of the gaps of a sorted array.

    A single gap has deviation 0; below two values the result is NULL.
    """

    def deviation(g: Column, mean: Column) -> Column:
        squares = _sum(g, lambda v: (v - mean) * (v - mean))
        spread_ = F.sqrt(squares / F.greatest(F.size(g) - 1, F.lit(1)))
        return F.when(mean != 0, spread_ / mean).otherwise(0.0) if normalize else spread_

    with_mean = lambda g: let(_sum(g) / F.size(g), lambda mean: deviation(g, mean))
    return let(gaps(times), lambda g: F.when(g.isNotNull(), with_mean(g)))


def _gap_variation(columns: list) -> np.ndarray:
    """``gap_variation`` of the known values of each row; 0 below two."""
    times = np.sort(np.stack(columns, axis=1), axis=1)  # NaN comes last
    gaps_of = np.maximum((~np.isnan(times)).sum(1) - 1, 0)
    early, late = times[:, :-1], times[:, 1:]
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.where(late == early, _ZERO_GAP, late - early)
        real = np.arange(gap.shape[1]) < gaps_of[:, None]
        total = lambda values: np.cumsum(np.where(real, values, 0.0), axis=1)[:, -1]
        mean = total(gap) / np.maximum(gaps_of, 1)
        spread_ = np.sqrt(total((gap - mean[:, None]) ** 2) / np.maximum(gaps_of - 1, 1))
        return np.where(mean != 0, spread_ / np.where(mean != 0, mean, 1.0), 0.0)


def timing_variance(df: DataFrame, columns=TIMING_FEATURES) -> Column:
    """Coefficient of variation of the gaps between the sorted timing features of a row.

    Absent columns and missing values are skipped; below two values the result is 0.
    """
    present = [F.col(c).cast("double") for c in columns if c in df.columns]
    if len(present) < 2:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def variation(*values: pa.Array) -> pa.Array:
        return pa.array(_gap_variation(_rows(*values)))

    return variation(*present)


NOISE_PARTS = [
    "q", "p_retrans", "p_iat", "p_bytes", "p_timing_iat", "p_timing_range",
    "p_timing_speed", "p_timing", "p",
]


def _noise_inputs(df: DataFrame) -> list:
    return [F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in NOISE_FEATURES]


def _noise(columns: list) -> dict:
    """The arrays of NOISE_PARTS. Like Spark's, the smaller of a number and NaN is the number, the larger is NaN."""
    v = dict(zip(NOISE_FEATURES, [np.where(c > 0, c, 0.0) for c in columns]))
    mean = lambda part: (v[f"SRC_TO_DST_{part}"] + v[f"DST_TO_SRC_{part}"]) / 2.0
    share = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0)
    least, greatest = np.fmin, np.maximum
    with np.errstate(invalid="ignore", over="ignore"):
        total = v["IN_BYTES"] + v["OUT_BYTES"]
        lost = v["RETRANSMITTED_IN_BYTES"] + v["RETRANSMITTED_OUT_BYTES"]
        lost_in = v["RETRANSMITTED_IN_PKTS"] / greatest(1.0, v["IN_PKTS"])
        lost_out = v["RETRANSMITTED_OUT_PKTS"] / greatest(1.0, v["OUT_PKTS"])
        jitter, high, mid, low = (mean(f"IAT_{part}") for part in ("STDDEV", "MAX", "AVG", "MIN"))
        rate = mean("SECOND_BYTES")
        burst = greatest(0.0, (share(high, mid) - 1.0) / 10.0)
        slow = greatest(0.0, (1000.0 - rate) / 10000.0)
        made = {
            "q": np.where(total > 0, share(v["IN_BYTES"], total), 0.5),
            "p_retrans": (lost_in + lost_out) / 2.0,
            "p_iat": 0.1 * least(1.0, jitter / 1000.0),
            "p_bytes": share(lost, total),
            "p_timing_iat": np.where(mid > 0, least(0.25, burst), least(0.25, high / 10000.0)),
            "p_timing_range": np.where(high > 0, least(0.05, share(high - low, high) * 0.1), 0.0),
            "p_timing_speed": np.where(rate > 0, least(0.05, slow), 0.05),
        }
        made["p_timing"] = least(0.3, made["p_timing_iat"] + made["p_timing_speed"] + made["p_timing_range"])
        mix = 0.5 * made["p_retrans"] + 0.2 * made["p_iat"] + 0.2 * made["p_bytes"] + 0.1 * made["p_timing"]
        # The clip at 0 is implied by the floor, which is positive.
        made["p"] = greatest(_P_FLOOR, least(mix, 1.0))
    return made


def noise_parts(df: DataFrame) -> Column:
    """Struct of the state population ``q``, the parts of the flip probability and ``p``."""

    @F.arrow_udf(", ".join(f"{name} double" for name in NOISE_PARTS))
    def parts(*values: pa.Array) -> pa.Array:
        made = _noise(_rows(*values))
        return pa.StructArray.from_arrays([pa.array(made[name]) for name in NOISE_PARTS], names=NOISE_PARTS)

    return parts(*_noise_inputs(df))


def _flip_entropy(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mean entropy of the pure state ``q`` after a bit flip and after a phase flip, as in ``channels``."""
    with np.errstate(invalid="ignore"):
        population, coherence = (2 * q - 1) * (2 * q - 1), 4 * (q * (1 - q))
        keep = (1 - 2 * p) * (1 - 2 * p)

        def part(value):
            counts = ~(value <= EPS)
            return np.where(counts, -value * np.log2(np.where(counts, value, 1.0)), 0.0)

        side = lambda gap: part((1 - gap) / 2) + part((1 + gap) / 2)
        return (side(np.sqrt(keep * population + coherence)) + side(np.sqrt(population + keep * coherence))) / 2


def quantum_noise_simulation(df: DataFrame) -> Column:
    """Mean von Neumann entropy of a flow's state under its own flip probability."""

    @F.arrow_udf("double")
    def entropy(*values: pa.Array) -> pa.Array:
        made = _noise(_rows(*values))
        return pa.array(_flip_entropy(made["q"], made["p"]))

    return entropy(*_noise_inputs(df))


def add_packet_entropy(df: DataFrame, columns=BYTES_FEATURES, out="packet_entropy") -> DataFrame:
    return df.withColumn(out, packet_entropy(df, columns))


def add_timing_variance(df: DataFrame, columns=TIMING_FEATURES, out="timing_variance") -> DataFrame:
    return df.withColumn(out, timing_variance(df, columns))


def add_noise_components(df: DataFrame) -> DataFrame:
    """Adds ``q``, the parts of the flip probability and ``p`` as columns."""
    return df.withColumn("_parts", noise_parts(df)).select(*df.columns, "_parts.*")


def add_noise_entropy(df: DataFrame, out="quantum_noise_simulation") -> DataFrame:
    return df.withColumn(out, quantum_noise_simulation(df))


def add_engineered_features(df: DataFrame) -> DataFrame:
    """All three engineered features in one narrow projection."""
    return df.withColumns(
        {
            "packet_entropy": packet_entropy(df),
            "timing_variance": timing_variance(df),
            "quantum_noise_simulation": quantum_noise_simulation(df),
        }
    )
