"""Inter-arrival variation of keyed time series and byte entropy of payloads."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.sizing import durable, join_small

ZERO_GAP = 1e-9
# A key is hot with over 1 / HOT_SHARE of all rows, if those are over HOT_ROWS.
HOT_SHARE = 1000
HOT_ROWS = 100_000
_CUTS = 256
# Payload bytes, and rows, whose byte values are counted at a time.
STRIP_BYTES = 1 << 20
STRIP_ROWS = 2048


def _with_ranges(rows: DataFrame, keys: list, width, hot_rows: int) -> DataFrame:
    """Adds ``_range``, a number that grows with ``_at`` inside a key.

    A hot key (fewer than HOT_SHARE can be) gets about as many ranges as the square root of
    its rows: quantiles cut its rows into _CUTS parts, and equal steps cut the parts. Other
    keys get ranges of ``width`` units.
    """
    fixed = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    least = max(hot_rows, rows.count() // HOT_SHARE)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
    hot = durable(sizes, "hot-keys")
    if not hot.limit(1).count():
        return rows.withColumn("_range", fixed)
    grid = [i / _CUTS for i in range(1, _CUTS)]
    cuts = join_small(rows, hot, keys, stored=True).groupBy(*keys, "_n").agg(
        F.concat(
            F.array(F.min("_at")), F.percentile_approx("_at", grid), F.array(F.max("_at"))
        ).alias("_cuts")
    )
    steps = F.ceil(F.sqrt("_n") / _CUTS).cast("bigint")
    # Of equal cuts the last one counts, so a part never has the width zero.
    part = F.least(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(_CUTS))
    low, high = F.get("_cuts", part - 1), F.get("_cuts", part)
    share = (F.col("_at") - low) / F.greatest((high - low).cast("double"), F.lit(1e-300))
    step = F.least(F.floor(share * steps).cast("bigint"), steps - 1)
    placed = join_small(rows, cuts, keys, "left")
    chosen = F.when(F.col("_cuts").isNull(), fixed).otherwise(part * steps + step)
    return placed.withColumn("_range", chosen.cast("bigint")).drop("_n", "_cuts")


def consecutive(df: DataFrame, keys: list, order_col: str, value_col: str, width,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Neighbouring values per key in ``order_col`` order: ``(keys, before, after)``.

    Rows are ordered inside ranges of ``width`` units, those of a hot key inside ranges of
    its own; the seams between a key's ranges come from one row per range. So a hot key is
    spread over its ranges. ``order_col`` must be unique per key.
    """
    rows = df.select(*keys, F.col(order_col).alias("_at"), F.col(value_col).alias("after"))
    rows = _with_ranges(rows, keys, width, hot_rows)
    inside = Window.partitionBy(*keys, "_range").orderBy("_at")
    pairs = rows.withColumn("before", F.lag("after").over(inside))
    ends = rows.groupBy(*keys, "_range").agg(
        F.min_by("after", "_at").alias("after"), F.max_by("after", "_at").alias("_last")
    )
    along = Window.partitionBy(*keys).orderBy("_range")
    seams = ends.withColumn("before", F.lag("_last").over(along))
    both = pairs.select(*keys, "before", "after").unionByName(seams.select(*keys, "before", "after"))
    return both.filter("before IS NOT NULL")


def interarrival(df: DataFrame, keys: list, ts_col: str, unit: float = 1.0, width=3_600_000_000,
                 strict: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deviation (ddof 1) and coefficient of variation of the gaps per key.

    ``ts_col`` is numeric; gaps are divided by ``unit``. Equal times are 1e-9 apart.
    One gap gives 0; a key with one row gives NULL, or an error with ``strict``.
    Equal times are combined before anything is ordered.
    """
    times = durable(df.select(*keys, F.col(ts_col).alias("_ts")).distinct(), "times")
    gaps = consecutive(times, keys, "_ts", "_ts", width, hot_rows).select(
        *keys,
        ((F.col("after") - F.col("before")) / F.lit(float(unit))).alias("_gap"),
        F.lit(0).cast("bigint").alias("_rows"),
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    sums = (
        gaps.unionByName(sizes.select(*keys, F.lit(None).cast("double").alias("_gap"), "_rows"))
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("events"),
            F.count("_gap").alias("_n"),
            F.avg("_gap").alias("_avg"),
            F.var_pop("_gap").alias("_var"),
        )
    )
    # Join the moments of the proper gaps with those of the equal-time gaps.
    m = F.col("events") - 1
    zeros = (m - F.col("_n")).cast("double")
    n, avg = F.col("_n").cast("double"), F.coalesce("_avg", F.lit(0.0))
    safe = F.greatest(m, F.lit(1))
    mean = (n * avg + zeros * ZERO_GAP) / safe
    apart = F.when(F.col("_n") > 0, avg - ZERO_GAP).otherwise(0.0)
    squares = n * F.coalesce("_var", F.lit(0.0)) + apart * apart * n * zeros / safe
    deviation = F.when(m == 1, 0.0).when(m > 1, F.sqrt(squares / F.greatest(m - 1, F.lit(1))))
    if strict:
        short = F.raise_error(F.lit("at least two timestamps are needed")).cast("double")
        deviation = F.when(m < 1, short).otherwise(deviation)
    return sums.select(
        *keys, "events", F.when(m >= 1, mean).alias("gap_mean"), deviation.alias("gap_std")
    ).withColumn("gap_cv", F.when(F.col("gap_mean") != 0, F.col("gap_std") / F.col("gap_mean")))


def in_time_order(df: DataFrame, keys: list, order_col: str, ts_col: str, width=1_000_000) -> DataFrame:
    """Per key, whether ``ts_col`` never decreases in ``order_col`` order: ``(keys, in_order)``."""
    pairs = consecutive(df, keys, order_col, ts_col, width)
    tests = pairs.select(*keys, (F.col("before") <= F.col("after")).alias("ok"))
    present = df.select(*keys, F.lit(True).alias("ok"))
    return tests.unionByName(present).groupBy(*keys).agg(F.min("ok").alias("in_order"))


def _payload(column) -> tuple:
    """Offsets and bytes of an Arrow string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return starts, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def _value_counts(starts, data, group, groups: int) -> np.ndarray:
    """Group x byte value: how often the bytes of a group's rows have each value, a strip at a time."""
    total = np.zeros((groups, 256), dtype=np.int64)
    for a in range(int(starts[0]), int(starts[-1]), STRIP_BYTES):
        b = min(a + STRIP_BYTES, int(starts[-1]))
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        lengths = np.diff(np.clip(starts[first : last + 1], a, b))
        seen, at = np.unique(group[first:last], return_inverse=True)
        codes = np.repeat(at * 256, lengths) + data[a:b]
        total[seen] += np.bincount(codes, minlength=len(seen) * 256).reshape(-1, 256)
    return total


@F.pandas_udf(T.DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy in bits of the UTF-8 (or raw) bytes; NULL for an empty payload."""
    out = np.full(len(payload), np.nan)
    column = pa.array(payload, from_pandas=True)
    for a in range(0, len(column), STRIP_ROWS):
        part = column.slice(a, STRIP_ROWS)
        counts = _value_counts(*_payload(part), np.arange(len(part)), len(part))
        size = counts.sum(1, keepdims=True)
        share = counts / np.maximum(size, 1)
        bits = -(share * np.log2(np.where(counts > 0, share, 1.0))).sum(1) + 0.0
        out[a : a + len(part)] = np.where(size[:, 0] > 0, bits, np.nan)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def partial_byte_counts(df: DataFrame, keys: list, payload_col: str) -> DataFrame:
    """Bytes per key and byte value inside each Arrow batch, to be summed: ``(keys, byte, n)``.

    Every key also has a row without a byte and n = 0, so that keys of empty payloads stay.
    """
    key_schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def count(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            combined = table.select(keys).append_column("_row", pa.array(np.arange(len(table))))
            groups = combined.group_by(keys, use_threads=False).aggregate([("_row", "list")])
            rows = groups["_row_list"].combine_chunks()
            group = np.zeros(len(table), dtype=np.int64)
            group[rows.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), rows.value_lengths().to_numpy())
            where, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            numbers = values
            if len(table):
                total = _value_counts(*_payload(table[payload_col]), group, len(groups))
                where, values = np.nonzero(total)
                numbers = total[where, values]
            bare = len(groups)
            columns = [groups[k].combine_chunks().take(pa.array(np.concatenate([np.arange(bare), where]))) for k in keys]
            columns += [pa.concat_arrays([pa.nulls(bare, pa.int32()), pa.array(values, pa.int32())]),
                        pa.array(np.concatenate([np.zeros(bare, dtype=np.int64), numbers]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "byte", "n"])

    return df.select(*keys, payload_col).mapInArrow(count, f"{key_schema}, byte int, n bigint")


def byte_counts(df: DataFrame, keys: list, payload_col: str) -> DataFrame:
    """Bytes per key and byte value: ``(keys, byte, n)``.

    Every Arrow batch counts its own bytes first, so only small counts are shuffled.
    """
    counts = partial_byte_counts(df, keys, payload_col).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))
    return counts.filter("byte IS NOT NULL")


def entropy_of_counts() -> list:
    """Columns ``bytes`` and ``entropy`` (bits) of a group of ``(byte, n)`` rows; no bytes, no entropy."""
    n = F.col("n").cast("double")
    entropy = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    return [
        F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"),
        F.when(F.sum(n) > 0, F.greatest(entropy, F.lit(0.0))).alias("entropy"),
    ]


def byte_entropy_by(df: DataFrame, keys: list, payload_col: str) -> DataFrame:
    """Entropy in bits of all bytes of a key's payloads: ``(keys, bytes, entropy)``.

    A key whose payloads are all empty or NULL has 0 bytes and no entropy.
    """
    counts = partial_byte_counts(df, keys, payload_col).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys).agg(*entropy_of_counts())
