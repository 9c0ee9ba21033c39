"""Connected components and blockwise work on groups of any size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.sizing import durable

# A table of at most this many group keys (8 to 16 bytes each) is broadcast.
SMALL_KEYS = 200_000


def small(df: DataFrame, rows: int = SMALL_KEYS) -> DataFrame:
    """A broadcast hint if a stored, narrow table has few rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge list; the component is its smallest node.

    Alternates large-star and small-star steps until the edges stay the same. Each step
    hangs nodes below smaller ones, so the number of rounds grows with the logarithm of
    the longest path. All work is on (node, node) rows with aggregates that combine before
    the shuffle; every round is written, so a lost executor costs one round at most.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = durable(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        low = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            edges.select(F.col("v").alias("n"), F.col("v").alias("m"))).groupBy("n").agg(F.min("m").alias("m"))
        large = edges.join(low, edges["v"] == low["n"]).select("u", F.col("m").alias("v"))
        large = large.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def in_blocks(members: DataFrame, sizes: DataFrame, key: str, id_col: str, hint: bool = True) -> DataFrame:
    """Rows of ``members`` dealt to pairs of blocks of their group: adds ``bi``, ``bj``, ``side``.

    ``sizes`` has (key, blocks) of the groups to keep. A group of one block is a single
    pair (0, 0). Otherwise a row's block comes from a hash of its id, and the row goes to
    every pair of blocks that holds its own; ``side`` is 0 for rows of block ``bi``, else 1.
    """
    dealt = members.join(small(sizes) if hint else sizes, key)
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"),
                               "side": (F.col("own") > F.col("other")).cast("int")})
    return dealt.drop("blocks", "own", "other")


def grouped(dealt: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a (key, bi, bj) group together and in order, ready for ``whole_groups``."""
    return dealt.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", order)


def whole_groups(batches, key: str, weight=lambda t: np.ones(t.num_rows), limit: int = 200_000):
    """(table, starts) of consecutive whole (key, bi, bj) groups of a sorted stream.

    ``starts`` are the first rows of the groups and the end. Tables hold groups of about
    ``limit`` weight together, or one larger group.
    """
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        starts = _starts(table, key)
        if len(starts) > 1:
            yield from _portions(table.slice(0, starts[-1]), starts, weight, limit)
        carry = table.slice(starts[-1])
    if carry is not None and carry.num_rows:
        yield from _portions(carry, np.array([0, carry.num_rows]), weight, limit)


def _starts(table, key):
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for c in (key, "bi", "bj"):
        values = table[c].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _portions(table, starts, weight, limit):
    total = np.concatenate([[0], np.cumsum(weight(table))])
    first = 0
    for k in range(1, len(starts)):
        if k == len(starts) - 1 or total[starts[k + 1]] - total[starts[first]] > limit:
            part = table.slice(starts[first], starts[k] - starts[first]).combine_chunks()
            yield part, starts[first : k + 1] - starts[first]
            first = k


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple:
    """Edges from every node of an edge list to the smallest node it is connected to in that list."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            some = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[some], nodes[label[some]]
        label = new


def stars(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric boolean matrix the smallest row it is connected to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
