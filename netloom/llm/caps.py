"""Near duplicates among embeddings with spherical-cap filters.

A filter is the set of unit vectors whose inner product with the filter's direction
exceeds a threshold. Directions form a random product code: the rotated space is cut into
parts, each part has a few random unit vectors, and a direction is one choice per part.
A vector's filters are found by list decoding: choices are added part by part, and a
partial sum that cannot reach the threshold any more is left. Vectors that share a filter
are compared; verified links give components, and inside a component all links are counted.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import table
from netloom.llm.graph import components, grouped, in_blocks, small, stars, whole_groups
from netloom.plans.sizing import durable, join_small

COSINE = 0.93
# Filters that a pair right at the cosine is expected to share over CODES codes. Several independent
# codes even out that the choices of one code hang together.
SHARED = 24.0
CODES = 4
# Share of the pairs right at the cosine that may have no filter in common: codes are added until
# the rate measured with random pairs allows it.
MISS = 1e-4
PAIRS = 1000
# Unrelated vectors of a label that are expected in a filter.
STRANGERS = 8.0
# Labels share the codes made for the next power of two of their rows, from this power on.
LEAST_GRADE = 8
BLOCK_ROWS = 1024


@lru_cache(maxsize=8)
def _angles(dim: int) -> tuple:
    """(angle, share of the sphere within that angle of a direction)."""
    angle = np.linspace(0, math.pi, 1 << 17)
    with np.errstate(divide="ignore"):
        density = np.exp((dim - 2) * np.log(np.sin(angle).clip(0))) if dim > 2 else np.ones(len(angle))
    within = np.concatenate([[0.0], np.cumsum(density[1:] + density[:-1])])
    return angle, within / within[-1]


def _tail(dot, dim: int):
    """Share of the unit vectors of ``dim`` components whose inner product with a direction is ``dot`` or more."""
    dot = np.asarray(dot, dtype=float)
    if dim == 1:
        return np.where(dot <= -1, 1.0, np.where(dot <= 1, 0.5, 0.0))
    return np.where(dot > 1, 0.0, np.interp(np.arccos(dot.clip(-1, 1)), *_angles(dim)))


def _threshold(share: float, dim: int) -> float:
    low, high = -1.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, dim) > share else (low, mid)
    return low


def _both(cut: float, cosine: float, dim: int) -> float:
    """Probability that a vector exceeds ``cut`` when one at ``cosine`` from it does."""
    if dim == 1 or cosine >= 1:
        return 1.0
    edges = np.linspace(0, math.acos(cut), 4001)
    weight = np.diff(_tail(np.cos(edges), dim))
    v = np.cos((edges[1:] + edges[:-1]) / 2)
    reach = _tail((cut - cosine * v) / np.sqrt((1 - cosine**2) * (1 - v * v)), dim - 1)
    return float((weight * reach).sum() / weight.sum())


class CapCode:
    """The product code for vectors of ``dim`` components and groups of about ``count`` vectors."""

    def __init__(self, dim: int, count: int, cosine: float = COSINE, shared: float = SHARED / CODES,
                 strangers: float = STRANGERS, seed=(11,)):
        # Filters need not be narrower than the cap that holds a vector's own links.
        share = min(0.25, max(1e-9, strangers / max(1, count), float(_tail(cosine, dim))))
        self.cut = _threshold(share, dim)
        wanted = shared / _both(self.cut, cosine, dim) / float(_tail(self.cut, dim))
        parts = 1
        most = max(1, min(dim // 2, 8))  # a part of one component has two directions only
        while parts < most and wanted ** (1 / parts) > 2048:  # the choices of few parts hang together less
            parts += 1
        parts = max(parts, min(2, most))
        size = max(2, math.ceil(wanted ** (1 / parts)))
        rng = np.random.default_rng([*seed, dim])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = np.linspace(0, dim, parts + 1).astype(int)
        # Each part's share of the direction is scaled by its size, so all directions have length 1.
        self.codes = []
        for a, b in zip(self.edges, self.edges[1:]):
            c = rng.normal(size=(size, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        self.size, self.least = size, self.cut

    def decode(self, unit: np.ndarray) -> tuple:
        """(row, filter number) of all filters that the rows exceed."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], self.codes)]
        best = np.array([s.max(1) for s in scores])
        rest = np.concatenate([np.cumsum(best[::-1], 0)[::-1][1:], np.zeros((1, len(unit)))])
        owner, number, total = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        for part, s in enumerate(scores):
            found, step = [], max(1, (1 << 20) // self.size)
            for a in range(0, max(1, len(owner)), step):  # sums of about 8 MB at a time
                own = owner[a:a + step]
                reach = total[a:a + step, None] + s[own]
                at, choice = np.nonzero(reach >= (self.least - rest[part][own])[:, None])
                found.append((own[at], number[a:a + step][at] * self.size + choice, reach[at, choice]))
            owner, number, total = (np.concatenate(x) for x in zip(*found))
        return owner, number


def missed(code: CapCode, dim: int, cosine: float, pairs: int, seed) -> int:
    """How many of ``pairs`` random pairs right at the cosine share no filter of the code."""
    rng, lost = np.random.default_rng(seed), pairs
    for a in range(0, pairs, 500):
        n = min(500, pairs - a)
        one = _unit(rng.normal(size=(n, dim)))
        side = rng.normal(size=(n, dim))
        side -= (side * one).sum(1, keepdims=True) * one
        other = cosine * one + math.sqrt(max(0.0, 1 - cosine**2)) * (_unit(side) if dim > 1 else 0 * side)
        sets = [np.stack(code.decode(x), 1) for x in (one, _unit(other))]
        both, seen = np.unique(np.concatenate(sets), axis=0, return_counts=True)
        lost -= len(np.unique(both[seen > 1, 0]))
    return lost


def codes_for(dim: int, count: int, cosine: float = COSINE, shared: float = SHARED, seed: int = 11) -> list:
    """Independent codes for groups of about ``count`` vectors.

    Each has its own random rotation, so the chances to miss a pair multiply: their number
    follows from the measured rate of one code plus three standard errors.
    """
    made = [CapCode(dim, count, cosine, shared / CODES, seed=(seed, k)) for k in range(CODES)]
    lost = sum(missed(code, dim, cosine, PAIRS, (seed, k, dim)) for k, code in enumerate(made))
    rate = min(0.99, (lost + 3 * math.sqrt(lost + 1)) / (CODES * PAIRS))
    number = max(CODES, math.ceil(math.log(MISS) / math.log(rate)))
    return made + [CapCode(dim, count, cosine, shared / CODES, seed=(seed, k)) for k in range(CODES, number)]


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(codes: dict, dim: int):
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                unit, grades = _unit(_matrix(batch["vec"], dim)), batch["grade"].to_numpy()
                for grade in np.unique(grades):
                    some = np.flatnonzero(grades == grade)
                    for k, code in enumerate(codes[int(grade)]):
                        owner, number = code.decode(unit[some])
                        at = pa.array(some[owner])
                        yield pa.RecordBatch.from_arrays(
                            [batch["rep"].take(at), batch["label"].take(at), pa.array(np.full(len(owner), k, dtype=np.int32)),
                             pa.array(number)], names=["rep", "label", "code", "filter"])

    return run


def _links(dim: int, cosine: float):
    """Star edges of the verified links inside each group."""
    def run(batches):
        for t, starts in whole_groups(batches, "key", limit=50_000):
            reps, unit, found = t["rep"].to_numpy(), _unit(_matrix(t["vec"], dim)), []
            for a, b in zip(starts, starts[1:]):
                linked = unit[a:b] @ unit[a:b].T >= cosine
                if linked.sum() > b - a:
                    top = stars(linked)
                    some = np.flatnonzero(top != np.arange(b - a))
                    found.append(np.stack([reps[a:b][some], reps[a:b][top[some]]]))
            if found:
                pairs = np.unique(np.concatenate(found, 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _counts(dim: int, cosine: float):
    """Documents linked to each representative by the other rows of a block pair."""
    def run(batches):
        for t, starts in whole_groups(batches, "component", limit=50_000):
            reps, copies, side = (t[c].to_numpy() for c in ("rep", "copies", "side"))
            unit, links = _unit(_matrix(t["vec"], dim)), np.zeros(t.num_rows, dtype=np.int64)
            mixed = t["bi"].to_numpy() != t["bj"].to_numpy()
            for a, b in zip(starts, starts[1:]):
                linked = unit[a:b] @ unit[a:b].T >= cosine
                np.fill_diagonal(linked, False)
                if mixed[a]:
                    linked &= side[a:b][:, None] != side[a:b][None, :]
                links[a:b] = linked @ copies[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links)], names=["rep", "links"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, shared: float = SHARED, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links of vectors of one label at ``cosine`` or more.

    Rows with equal label and vector are one class; its copies are linked to one another
    and count in ``n_links``. Null, empty or zero vectors, vectors that hold null or
    non-finite components, and rows with null label or id link with nothing: their
    component is their own id. Vectors are compared only with those of the same length.
    Of rows that repeat an id each is a row of its own with that id. Other columns are left
    out; an empty table gives no rows.
    """
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    fine = F.coalesce(
        F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0),
        F.lit(False))
    digest = F.md5(F.concat_ws(" ", F.col(label_col).cast("string"), F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.when(fine, vec).alias("vec"), F.when(fine, digest).alias("class"))
    rows = durable(rows, "vectors")
    # Classes are numbered, as rows that repeat an id may differ in their vectors.
    reps = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    reps = durable(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    dims = [r["dim"] for r in reps.groupBy(F.size("vec").alias("dim")).count().collect()]  # one row per vector length
    edges = linked = None
    for dim in sorted(dims):
        edges = _union(edges, _dim_edges(reps, dim, cosine, shared, seed))
    classes = reps.select("class", "rep", "low", "copies")
    if edges is None:
        classes = classes.select("*", F.lit(0).alias("links"), F.col("low").alias("component_id"))
    else:
        found = durable(components(edges), "components")
        for dim in sorted(dims):
            linked = _union(linked, _dim_counts(reps, found, dim, cosine))
        totals = linked.groupBy("rep").agg(F.sum("links").alias("links"))
        lows = found.join(classes, F.col("node") == F.col("rep"))
        lows = lows.groupBy("component").agg(F.min("low").alias("component_id"))
        classes = classes.join(found, F.col("rep") == F.col("node"), "left").join(lows, "component", "left").join(totals, "rep", "left")
    classes = classes.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component_id", "low").alias("component_id"))
    # Rows without a class link with nothing and join with nothing.
    linkable = join_small(rows.where("class IS NOT NULL").select("id", "class"), classes, ["class"])
    alone = rows.where("class IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linkable.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    out = out.withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _union(a, b):
    return b if a is None else a.unionByName(b)


def _dim_edges(reps, dim, cosine, shared, seed):
    own = reps.filter(F.size("vec") == dim)
    grade = F.greatest(F.lit(LEAST_GRADE), F.ceil(F.log2(F.count(F.lit(1))))).cast("int")
    grades = durable(own.groupBy("label").agg(grade.alias("grade")), "grades")
    codes = {r["grade"]: codes_for(dim, 2 ** r["grade"], cosine, shared, seed) for r in grades.select("grade").distinct().collect()}
    graded = join_small(own.select("rep", "label", "vec"), grades, ["label"], stored=True)
    placed = graded.select("rep", "label", "vec", "grade").mapInArrow(_filters(codes, dim), "rep long, label string, code int, filter long")
    placed = durable(placed.select("rep", F.xxhash64("label", "code", "filter").alias("key")), "filters")
    sizes = placed.groupBy("key").count().filter("count > 1").select(
        "key", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    dealt = in_blocks(placed, durable(sizes, "filter-sizes"), "key", "rep")
    dealt = dealt.join(own.select("rep", "vec"), "rep")
    return grouped(dealt, "key", "rep").select("key", "bi", "bj", "rep", "vec").mapInArrow(_links(dim, cosine), "a long, b long")


def _dim_counts(reps, found, dim, cosine):
    own = reps.filter(F.size("vec") == dim).join(found, F.col("rep") == F.col("node")).select("component", "rep", "copies", "vec")
    sizes = own.groupBy("component").count().select("component", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    dealt = in_blocks(own, durable(sizes, "component-sizes"), "component", "rep")
    return grouped(dealt, "component", "rep").select("component", "bi", "bj", "side", "rep", "copies", "vec").mapInArrow(
        _counts(dim, cosine), "rep long, links long")


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
