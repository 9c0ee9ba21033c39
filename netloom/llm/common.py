"""Helpers shared by the operators of this package."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.plans.sizing import durable

# Texts are taken from an Arrow batch in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Sub-batches of a batch whose values of ``column`` hold about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release():
    """Return free memory to the machine, as Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    """Python strings of a text column, null as the empty string."""
    return [t or "" for t in batch[column].to_pylist()]


def portions(texts: pa.Array, limit: int):
    """Pieces of a text array with about ``limit`` bytes, whose arrays stay small."""
    cut = np.flatnonzero(np.diff(np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64)) // limit)) + 1
    edges = [0, *cut.tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def plain_strings(column: pa.Array) -> pa.Array:
    """A text column with null as the empty string."""
    return pc.fill_null(column.cast(pa.string()), "")


def runs(mask: np.ndarray):
    """(start, end, value) of stretches of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(mask)) + 1).tolist(), len(mask)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, b, bool(mask[a])


def text_bytes(column: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of all values of a string column without nulls, one after another."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[s : s + n]`` for all starts and lengths."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def list_array(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def with_unique_id(df: DataFrame, id_col: str, columns: list, name: str) -> tuple:
    """(table, id column) such that no id is null or repeated.

    When the ids are unique the table is ``df`` itself. Otherwise it is a stored copy
    with the row's number in the order of (id, content) as id ``__row``, so that repeated rows
    stay apart. The numbers depend on the rows alone, not on how they are partitioned; rows
    that are equal in all ``columns`` may change places.
    """
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"),
                   F.countDistinct(id_col).alias("different")).first()
    if found["n"] == found["ids"] == found["different"]:
        return df, id_col
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])))
    rows = durable(df.select(*columns, content.alias("__content"), F.monotonically_increasing_id().alias("__place")), name)
    # Equal rows differ in their place, so that they are dealt to many ranges.
    order = [F.col(f"`{id_col}`"), F.col("__content"), F.col("__place")]
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = durable(ordered.select(*columns, F.monotonically_increasing_id().alias("__place")), name)
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select(*columns, (F.col("__start") + F.col("__place").bitwiseAND((1 << 33) - 1)).alias("__row")), "__row"


def map_texts(df: DataFrame, text_col: str, fields: str, make, more: tuple = (), keep: list | None = None) -> DataFrame:
    """``df`` with columns computed from a text column, a slice of rows at a time.

    ``make()`` runs once per task and returns a function from the slice's texts (an Arrow
    string array without nulls), and the values of the columns ``more``, to one Arrow array
    per field. Fields named like a column of ``df`` replace it; ``keep`` names the columns
    of ``df`` that go through (all by default).
    """
    added = df.sparkSession.createDataFrame([], fields).schema
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    inner = {c: f"c{i}" for i, c in enumerate(kept)}
    text = inner.get(text_col, "text")  # a text that goes through is sent once
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()],
                      *([] if text_col in inner else [F.col(f"`{text_col}`").alias(text)]),
                      *[F.col(f"`{c}`").alias(f"more{i}") for i, c in enumerate(more)])
    schema = given.select(*inner.values()).schema
    for field in added:
        schema = schema.add(f"n_{field.name}", field.dataType)

    def run(batches):
        fn = make()
        for whole in batches:
            for batch in slices(whole, text):
                values = fn(plain_strings(batch[text]), *[batch[f"more{i}"] for i in range(len(more))])
                yield pa.RecordBatch.from_arrays(
                    [batch[n] for n in inner.values()] + list(values), names=schema.names)
            release()

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()],
                      *[F.col(f"n_{f.name}").alias(f.name) for f in added])


def renamed(df: DataFrame) -> tuple:
    """(``df`` with columns c0, c1, ..., a function that selects them back under their names).

    For work that adds columns: their names cannot clash with those of ``df``.
    """
    names = df.columns
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return inner, lambda out: out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
