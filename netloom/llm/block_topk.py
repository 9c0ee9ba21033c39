"""Exact top-k search by inner product with block-at-a-time pruning.

The vectors are ordered so that like ones are close (by signs of random projections) and
cut into blocks. A block keeps its vectors as a forward index and the largest and smallest
value of every component. A query's bound for a block is the sum over its components of
the larger of the two products. A query visits the blocks in the order of their bounds and
stops when they fall below its k-th score. A first pass over the block maxima alone finds
every query's best block, whose scores give the threshold that all tasks start from.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import table
from netloom.plans.sizing import durable

SCALE = 256
BLOCK = 128
PLANES = 16
# Query vectors broadcast at a time, in bytes.
QUERY_BYTES = 8 << 20
# Sums of products below this are exact in double precision.
_EXACT = 2.0**52


def _whole(vec: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(scale * np.asarray(vec.flatten(), dtype=np.float64)).reshape(-1, dim)


def _coded(dim: int, scale: int, planes: np.ndarray):
    """Adds the sign code and the whole-number components as 8-byte values."""
    def run(batches):
        for batch in batches:
            x = _whole(batch["vec"], dim, scale)
            code = ((x @ planes) > 0) @ (1 << np.arange(planes.shape[1]))
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(code.astype(np.int64)), pa.array(raw, pa.binary())], names=["id", "code", "raw"])

    return run


def _blocks(dim: int):
    """One row per block: ids in order, components, and their extremes."""
    def row(part, ids, x):
        order = np.argsort(ids, kind="stable")
        x = x[order]
        return (ids[order], x.tobytes(), x.max(0).tobytes(), x.min(0).tobytes())

    def run(batches):
        ids, vectors = np.zeros(0, dtype=np.int64), np.zeros((0, dim))
        for batch in batches:
            ids = np.concatenate([ids, batch["id"].to_numpy()])
            vectors = np.concatenate([vectors, np.frombuffer(b"".join(batch["raw"].to_pylist()), dtype=np.float64).reshape(-1, dim)])
            full = len(ids) // BLOCK * BLOCK
            if full:
                yield _block_batch([row(0, ids[a : a + BLOCK], vectors[a : a + BLOCK]) for a in range(0, full, BLOCK)])
                ids, vectors = ids[full:], vectors[full:]
        if len(ids):
            yield _block_batch([row(0, ids, vectors)])

    return run


def _block_batch(rows):
    ids, raw, high, low = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.list_(pa.int64())), *[pa.array(c, pa.binary()) for c in (raw, high, low)]], names=["ids", "raw", "high", "low"])


def _extremes(batch, dim):
    return [np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.float64).reshape(-1, dim) for c in ("high", "low")]


def _bounds(queries, high, low):
    """Query x block: no vector of the block scores more."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _top(owner, ids, scores, k):
    """The k best (score, smaller id) of each owner, sorted by owner."""
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    first = np.searchsorted(owner, owner, side="left")
    keep = np.arange(len(owner)) - first < k
    return owner[keep], ids[keep], scores[keep]


def _best_blocks(shared, dim):
    def run(batches):
        ids, queries, _ = shared.value
        best, at = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            blocks = batch["block"].to_numpy()
            for a in range(0, len(ids), 2048):
                bound = _bounds(queries[a : a + 2048], *_extremes(batch, dim))
                top = bound.argmax(1)
                value = bound[np.arange(len(top)), top]
                better = value > best[a : a + 2048]
                best[a : a + 2048][better], at[a : a + 2048][better] = value[better], blocks[top[better]]
        some = np.flatnonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(best[some]), pa.array(at[some])], names=["query", "bound", "block"])

    return run


def _scored(queries, query_ids, rows, ids, raw, dim):
    """(query row, id, score) of the vectors of one block for some queries, the query itself left out."""
    x = np.frombuffer(raw, dtype=np.float64).reshape(-1, dim)
    score = queries[rows] @ x.T
    score[query_ids[rows][:, None] == ids[None, :]] = -np.inf
    return score


def _search(shared, dim, k):
    def run(batches):
        ids, queries, least = shared.value
        least = least.copy()
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for batch in batches:
            members, raws = batch["ids"], batch["raw"]
            members = [np.asarray(m.values) for m in members]
            bound = np.concatenate([_bounds(queries[a : a + 2048], *_extremes(batch, dim)) for a in range(0, len(ids), 2048)])
            order = np.argsort(-bound, axis=1, kind="stable")
            for turn in range(order.shape[1]):
                block = order[:, turn]
                alive = np.flatnonzero(bound[np.arange(len(ids)), block] >= least)
                if not len(alive):
                    break
                new = [found]
                for b in np.unique(block[alive]):
                    rows = alive[block[alive] == b]
                    score = _scored(queries, ids, rows, members[b], raws[int(b)].as_py(), dim)
                    q, c = np.nonzero(score >= np.maximum(least[rows], -1e300)[:, None])
                    new.append((rows[q], members[b][c], score[q, c]))
                found = _top(*map(np.concatenate, zip(*new)), k)
                kth = np.flatnonzero(np.bincount(found[0], minlength=len(ids)) >= k)
                last = np.searchsorted(found[0], kth, side="right") - 1
                least[kth] = np.maximum(least[kth], found[2][last])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner product per query.

    Components are floor(scale * x). Ties go to the smaller id; a row with the query's own
    id is no candidate. Vectors that are null, empty or hold null or non-finite components,
    and rows without id, take no part; a vector meets only queries of its length. Of equal
    rows of ``queries`` one counts; of different ones with one id the first by components.
    Scores are exact while they stay below 2^52, beyond that a ValueError is raised.
    Queries are handled in batches of a fixed size in bytes, each against all blocks.
    """
    slim = _usable(vectors, id_col, vec_col)
    asked = _usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    slim, asked = durable(slim, "vectors"), durable(asked, "queries")
    kinds = slim.groupBy(F.size("vec").alias("dim")).agg(
        F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most")).collect()  # one row per length
    parts = [p for r in sorted(kinds) for p in _by_length(slim, asked, r["dim"], r["most"], k, scale, seed)]
    if not parts:
        return slim.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _usable(df, id_col, vec_col):
    vec = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(fine)


def _by_length(slim, asked, dim, most, k, scale, seed):
    if (scale * most + 1) ** 2 * dim >= _EXACT:
        raise ValueError("components are too large for exact scores")
    spark = slim.sparkSession
    planes = np.random.default_rng([seed, dim]).normal(size=(dim, PLANES))
    coded = slim.filter(F.size("vec") == dim).mapInArrow(_coded(dim, scale, planes), "id long, code long, raw binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id")
    blocks = ordered.mapInArrow(_blocks(dim), "ids array<long>, raw binary, high binary, low binary")
    blocks = durable(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    own = asked.filter(F.size("vec") == dim)
    count = own.count()
    batches = math.ceil(count * dim * 8 / QUERY_BYTES)
    for b in range(batches):
        some = own.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b).orderBy("id").toArrow()  # about QUERY_BYTES
        if not some.num_rows:
            continue
        ids = some["id"].to_numpy()
        x = _whole(some["vec"].combine_chunks(), dim, scale)
        start = spark.sparkContext.broadcast((ids, x, None))
        best = blocks.select("block", "high", "low").mapInArrow(_best_blocks(start, dim), "query long, bound double, block long")
        best = best.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
        first = best.join(blocks, "block").select("query", "ids", "raw")
        seeds = first.mapInArrow(_seeds(start, dim, k), "query long, least double").toArrow()  # one row per query of the batch
        least = np.full(len(ids), -np.inf)
        least[np.searchsorted(ids, seeds["query"].to_numpy())] = seeds["least"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, x, least))
        found = blocks.select("ids", "raw", "high", "low").mapInArrow(_search(shared, dim, k), "query_id long, vec_id long, score long")
        yield found if batches == 1 else durable(found, "found")


def _seeds(shared, dim, k):
    """Per query the k-th score inside its best block."""
    def run(batches):
        ids, queries, _ = shared.value
        for batch in batches:
            rows = np.searchsorted(ids, batch["query"].to_numpy())
            least = []
            for row, members, raw in zip(rows, batch["ids"], batch["raw"]):
                score = _scored(queries, ids, np.array([row]), np.asarray(members.values), raw.as_py(), dim)[0]
                least.append(np.sort(score)[-k] if len(score) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([batch["query"], pa.array(least, pa.float64())], names=["query", "least"])

    return run


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
