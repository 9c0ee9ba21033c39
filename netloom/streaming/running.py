"""Inter-arrival variation that runs on per key, across all windows, on streams.

Closed panes bring a key's first and last time and the moments of its gaps; the key's
state holds the last time seen and the merged moments, a few numbers however long the
stream runs. Every pane row is folded once, in time order, so the state after any batch is
that of the batch operator over all events up to there. Late events, older than the
watermark, are left out with their pane. A timer ends keys that stay silent.
"""

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.operators.series import ZERO_GAP
from netloom.streaming.flow_stream import gap_panes

_STATE = "last bigint, events bigint, mean double, m2 double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(n: float, mean: float, m2: float, n2: float, mean2: float, m22: float) -> tuple:
    """Moments (count, mean, sum of squared deviations) of two groups together."""
    total = n + n2
    if not total:
        return 0, 0.0, 0.0
    apart = mean2 - mean
    return total, mean + apart * n2 / total, m2 + m22 + apart * apart * n * n2 / total


def fold(state, pane) -> tuple:
    """(last, events, mean, m2) of a key after a pane (first, last, rows, n, mean, m2) behind its state."""
    first, last, rows, n, mean, m2 = pane
    # Gaps of different times inside the pane, and those of equal times.
    own = merged(n, mean, m2, rows - 1 - n, ZERO_GAP, 0.0)
    if state is None:
        return last, rows, own[1], own[2]
    before = merged(state[1] - 1, state[2], state[3], 1, (first - state[0]) / 1e6, 0.0)
    _, mean, m2 = merged(*before, *own)
    return last, state[1] + rows, mean, m2


class _RunningGaps(StatefulProcessor):
    """State of one key; see ``running_gaps``."""

    def __init__(self, keys: list, expire_ms):
        self.keys, self.expire_ms = keys, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.moments = handle, handle.getValueState("moments", _STATE)

    def _row(self, key, state, ended: bool) -> pd.DataFrame:
        last, events, mean, m2 = state
        gaps = events - 1
        std = None if gaps < 1 else (m2 / max(gaps - 1, 1)) ** 0.5 if gaps > 1 else 0.0
        out = {c: [v] for c, v in zip(self.keys, key)}
        out |= {"upto_us": [last], "events": [events], "gap_mean": [mean if gaps else None], "gap_std": [std], "ended": [ended]}
        return pd.DataFrame(out)

    def handleInputRows(self, key, rows, timerValues):
        panes = pd.concat(rows).sort_values("first")
        state = self.moments.get() if self.moments.exists() else None
        for pane in panes[["first", "last", "rows", "n", "mean", "m2"]].itertuples(index=False):
            state = fold(state, pane)
        state = (int(state[0]), int(state[1]), float(state[2]), float(state[3]))
        self.moments.update(state)
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(state[0] // 1000 + self.expire_ms)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.moments.get()
        self.moments.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def running_gaps(events: DataFrame, keys: list, ts_col: str, pane: str = "1 second", delay: str = "10 minutes",
                 expire_seconds: float | None = None) -> DataFrame:
    """Running gap statistics per key of a stream: ``(keys, upto_us, events, gap_mean, gap_std, ended)``.

    A batch gives one row per key whose panes closed in it, over all of the key's events so
    far; ``latest`` picks the last one. Equal times are 1e-9 apart; one gap has the deviation
    0, one event none. Events without a time belong to no pane; a null key is a key. With
    ``expire_seconds`` a key that long behind the watermark gives a last row with ``ended``
    and is forgotten; later events begin it anew. Needs the keyed state store (``keyed_state``).
    """
    timed = events.where(F.col(ts_col).isNotNull())
    panes = gap_panes(timed, keys, ts_col, pane, delay).select(
        *keys, F.window_time("window").alias("_ts"), F.col("_part.first").alias("first"), F.col("_part.last").alias("last"),
        F.col("_rows").alias("rows"), F.col("_part.n").alias("n"), F.col("_part.mean").alias("mean"), F.col("_part.m2").alias("m2"))
    schema = T.StructType([events.schema[k] for k in keys])
    for name, kind in (("upto_us", "long"), ("events", "long"), ("gap_mean", "double"), ("gap_std", "double"), ("ended", "boolean")):
        schema = schema.add(name, kind)
    expire_ms = None if expire_seconds is None else int(expire_seconds * 1000)
    return panes.groupBy(*keys).transformWithStateInPandas(
        _RunningGaps(keys, expire_ms), schema, "append", "EventTime" if expire_ms is not None else "None")


def latest(running: DataFrame, keys: list) -> DataFrame:
    """The last row of every key of a written ``running_gaps`` table, with ``gap_cv``."""
    last = F.max(F.struct("events", *[c for c in running.columns if c not in (*keys, "events", "ended")])).alias("_last")
    rows = running.where(~F.col("ended")).groupBy(*keys).agg(last).select(*keys, "_last.*")
    return rows.withColumn("gap_cv", F.when(F.col("gap_mean") > 0, F.col("gap_std") / F.col("gap_mean")))


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in the store that keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _KEYED_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
