"""Noise-channel metrics for a table of states over a grid of flip probabilities."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import channels as ch
from netloom.plans.sizing import durable


# Values of p in one row of a stored grid.
GRID_PART = 1000


def _grid_parts(p_values: DataFrame) -> DataFrame:
    """(part, grid): the values in lists of at most about GRID_PART."""
    values = durable(p_values.select(F.col("p").cast("double").alias("p")), "grid")
    size, bad = values.agg(F.count(F.lit(1)), F.count(F.when(F.coalesce(F.col("p").between(0, 1), F.lit(False)), None).otherwise(1))).first()
    if bad or not size:
        raise ValueError("every p must lie in [0, 1]")
    parts = math.ceil(size / GRID_PART)
    place = F.pmod(F.row_number().over(Window.partitionBy("block").orderBy("p")), F.lit(parts))
    dealt = values.withColumn("block", F.pmod(F.xxhash64("p"), F.lit(parts))).withColumn("part", place.cast("int") if parts > 1 else F.lit(0))
    lists = durable(dealt.groupBy("part").agg(F.collect_list("p").alias("grid")), "grid-parts")
    return lists.withColumn("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("int"))  # one row per GRID_PART values


def channel_sweep(states: DataFrame, id_col: str, p_values=None, names=ch.CHANNELS, base: float = 2) -> DataFrame:
    """One row per state, channel and p: fidelity, purity, entropy and the noisy state.

    ``states`` has the population ``q`` and, optionally, the coherence ``c`` (that
    of the pure state by default). ``p_values`` is a list, or a table with a column
    ``p`` of any length. A state unfolds a list by itself; a table is cut into parts of
    ``GRID_PART`` values, and a state unfolds one part after another.
    """
    if isinstance(p_values, DataFrame):
        parts = _grid_parts(p_values)
    else:
        parts = None
        grid = ch.check_grid(ch.DEFAULT_GRID if p_values is None else p_values)
    c = F.col("c") if "c" in states.columns else ch.pure_coherence(F.col("q"))
    rows = states.select(F.col(id_col), F.col("q").cast("double").alias("q"), c.cast("double").alias("c"))
    if parts is None:
        rows = rows.withColumn("p", F.explode(F.array(*[F.lit(p) for p in grid])))
    else:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(parts.count() - 1)))
        rows = rows.withColumn("part", numbers).join(parts, "part").withColumn("p", F.explode("grid"))
    q, c, p = F.col("q"), F.col("c"), F.col("p")
    each = [
        F.struct(
            F.lit(name).alias("channel"),
            ch.spread(q, c, p, name).alias("g"),
            ch.noisy_population(q, p, name).alias("r00"),
            ch.noisy_coherence(c, p, name).alias("r01"),
        )
        for name in names
    ]
    rows = rows.select(id_col, "q", "c", "p", F.inline(F.array(*each)))
    rows = rows.withColumn(
        "fidelity_sq", ch.fidelity_squared(q, c, F.col("r00"), F.col("r01"))
    )
    return rows.select(
        id_col, "q", "c", "channel", "p",
        F.sqrt("fidelity_sq").alias("fidelity"),
        "fidelity_sq",
        ch.purity(F.col("g")).alias("purity"),
        ch.spread_entropy(F.col("g"), base).alias("entropy"),
        "r00", "r01",
        (1 - F.col("r00")).alias("r11"),
    )


def default_state(df: DataFrame) -> DataFrame:
    """Adds the equal superposition: q = c = 1/2."""
    return df.withColumns({"q": F.lit(0.5), "c": F.lit(0.5)})


def state_validity(df: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Flags for matrices ``r00, r01, r10, r11``: Hermitian, trace 1, and not negative."""
    trace = F.col("r00") + F.col("r11")
    flags = {
        "hermitian": F.abs(F.col("r01") - F.col("r10")) <= tol,
        "unit_trace": F.abs(trace - 1.0) <= tol,
        "positive": (F.col("r00") >= -tol)
        & (F.col("r11") >= -tol)
        & (F.col("r01") * F.col("r10") <= F.col("r00") * F.col("r11") + tol),
    }
    flags = {name: F.coalesce(test, F.lit(False)) for name, test in flags.items()}
    return df.withColumns(flags).withColumn("valid", F.col("hermitian") & F.col("unit_trace"))
