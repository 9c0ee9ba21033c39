"""Whitened coordinates of embeddings from a pivoted Cholesky factor and one-sided Jacobi.

Vectors become whole numbers, so their count, sums and distances from the mean are exact.
Tasks add up the scatter of the centred vectors, one matrix each. The scatter (as large as
the dimension, however many rows) is factored on the driver: a Cholesky factor with
pivoting, whose columns one-sided Jacobi rotations then make orthogonal. The rotated
columns' norms are the square roots of the eigenvalues, the normalised columns the
components.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import table
from netloom.plans.sizing import durable

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# A square matrix of this many columns (128 MB) is the largest one factored.
MOST_DIMS = 4096
# Rows turned into a matrix in one go hold about so many numbers.
NUMBERS = 1 << 20
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor f with f @ f.T equal to a symmetric positive semidefinite matrix up to rounding.

    Each step takes the largest remaining diagonal entry as pivot. It ends when that is
    rounding error only, so f has as many columns as the matrix has rank.
    """
    n = len(a)
    rest, left = np.diag(a).astype(float).copy(), np.ones(n, dtype=bool)
    tiny = n * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    columns = []
    while left.any():
        pivot = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[pivot] <= tiny:
            break
        column = a[:, pivot] - sum((c * c[pivot] for c in columns), np.zeros(n))
        column = column / np.sqrt(column[pivot]) if column[pivot] > tiny else None
        left[pivot] = False
        if column is None:
            continue
        column[~left & (np.arange(n) != pivot)] = 0.0  # rows of earlier pivots
        columns.append(column)
        rest = rest - column * column
    return np.stack(columns, 1) if columns else np.zeros((n, 0))


def _rounds(n: int):
    """Disjoint pairs of columns in rounds, such that each pair comes once (n even)."""
    ring = list(range(n))
    for _ in range(n - 1):
        yield np.array(ring[: n // 2]), np.array(ring[: n // 2 - 1 : -1])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi_columns(factor: np.ndarray) -> tuple:
    """(eigenvalues, components as columns) of factor @ factor.T, largest first.

    Pairs of columns are rotated until every two are orthogonal to double precision.
    """
    d, n = factor.shape
    if not n:
        return np.zeros(0), np.zeros((d, 0))
    work = np.zeros((d, n + n % 2))
    work[:, :n] = factor
    eps = np.finfo(float).eps * np.sqrt(d)
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(work.shape[1]) if work.shape[1] > 1 else ():
            a, b = work[:, p], work[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            worst = max(worst, off.max())
            turn = off > eps
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            work[:, p[turn]], work[:, q[turn]] = c * a[:, turn] - c * t * b[:, turn], c * t * a[:, turn] + c * b[:, turn]
        if worst <= eps:
            break
    norms = np.linalg.norm(work, axis=0)
    order = np.argsort(-norms, kind="stable")[:n]
    order = order[norms[order] > 0]
    return norms[order] ** 2, work[:, order] / norms[order]


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the vectors that take part, stored; x is an array of whole numbers."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.coalesce(
        (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform(vec, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return durable(vectors.where(fine).select(F.col(f"`{id_col}`").alias("id"), x.alias("x")), "whole-vectors")


def _matrices(batch, dim: int):
    """(first row, matrix of whole numbers) of an Arrow batch, some rows at a time."""
    step = max(1, NUMBERS // dim)
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield part, np.asarray(part["x"].flatten(), dtype=np.int64).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly; raises OverflowError beyond 63 bits."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 1 << 63:
        raise OverflowError("count times vector entry passes 63 bits")
    return x * n - sums


def _scatter(fits: dict, project: dict | None = None):
    """One matrix per task and dimension: the scatter of centred, or of centred and projected, rows."""
    def run(batches):
        total: dict = {}
        for batch in batches:
            sizes = np.asarray(batch["dim"])
            for dim in np.unique(sizes).tolist():
                n, sums = fits[dim]
                for _, x in _matrices(batch.filter(pa.array(sizes == dim)), dim):
                    y = _centred(x, n, sums) / n
                    if project is not None:
                        y = np.concatenate([y @ project[dim], np.ones((len(y), 1))], 1)
                    total[dim] = total.get(dim, 0.0) + y.T @ y
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), dim, dtype=np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                 pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "entries"])

    return run


def _sums(batches):
    """(dim, j, s, n) of a task: sums of the entries j and the number of vectors, per dimension."""
    total: dict = {}
    for batch in batches:
        sizes = np.asarray(batch["dim"])
        for dim in np.unique(sizes).tolist():
            for _, x in _matrices(batch.filter(pa.array(sizes == dim)), dim):
                n, s, most = total.get(dim, (0, 0, 0))
                most = max(most, int(np.abs(x).max()))
                if most * (n + len(x)) >= 1 << 63:
                    raise OverflowError("a sum of vector entries passes 63 bits")
                total[dim] = n + len(x), s + x.sum(0), most
    for dim, (n, s, _) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim, dtype=np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(s),
             pa.array(np.full(dim, n, dtype=np.int64))], names=["dim", "j", "s", "n"])


def _sum_matrices(rows: DataFrame, fits: dict, project: dict | None = None) -> dict:
    """{dimension: matrix} summed over all rows; combined in tasks, then entry by entry."""
    parts = rows.select("dim", "x").mapInArrow(_scatter(fits, project), "dim int, i int, entries array<double>")
    entries = parts.select("dim", "i", F.posexplode("entries").alias("j", "v"))
    summed = entries.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # as many rows as a matrix has entries
    out = {}
    for dim, cells in summed.groupby("dim"):
        size = int(cells["i"].max()) + 1
        out[dim] = np.zeros((size, size))
        out[dim][cells["i"], cells["j"]] = cells["v"]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict:
    """{dimension: (n, sums, eigenvalues, components as columns, trace, identity error)} of ``whole_vectors`` rows."""
    rows = rows.withColumn("dim", F.size("x"))
    most = rows.agg(F.max("dim")).first()[0]
    if most is None:
        return {}
    if most > MOST_DIMS:
        raise ValueError(f"vectors have over {MOST_DIMS} entries")
    sums = rows.select("dim", "x").mapInArrow(_sums, "dim int, j int, s long, n long")
    sums = sums.groupBy("dim", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()  # a row per entry of a vector
    fits = {}
    for dim, cells in sums.sort_values("j").groupby("dim"):
        fits[dim] = (int(cells["n"].iloc[0]), cells["s"].to_numpy(dtype=np.int64))
    out, project = {}, {}
    for dim, scatter in _sum_matrices(rows, fits).items():
        n, total = fits[dim]
        variance = scatter / n
        values, vectors = jacobi_columns(pivoted_cholesky(variance))
        values, vectors = values[:components], vectors[:, :components]
        out[dim] = [n, total, values, vectors, float(np.trace(variance))]
        project[dim] = vectors / np.sqrt(values)
    for dim, m in _sum_matrices(rows, fits, project).items():
        n = out[dim][0]
        mean = m[-1, :-1] / n
        error = np.abs(m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean)))
        out[dim].append(float(error.max(initial=0.0)))
    return out


def _project(fits: dict):
    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch["dim"])
            for dim in np.unique(sizes).tolist():
                n, sums, values, vectors, trace, error = fits[dim]
                for part, x in _matrices(batch.filter(pa.array(sizes == dim)), dim):
                    y = _centred(x, n, sums)
                    fits_long = not len(y) or dim * int(np.abs(y).max()) ** 2 < 1 << 63
                    exact = y if fits_long else y.astype(object)
                    deviation = pa.array((exact * exact).sum(1).tolist(), pa.decimal128(38))
                    white, rows, count = y / n @ vectors / np.sqrt(values), len(y), len(values)
                    yield pa.RecordBatch.from_arrays(
                        [part["id"].take(pa.array(np.repeat(np.arange(rows), count))),
                         pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                         pa.array(np.full(rows * count, n, dtype=np.int64)),
                         deviation.take(pa.array(np.repeat(np.arange(rows), count))),
                         pa.array(white.ravel()), pa.array(np.tile(values / trace, rows)),
                         pa.array(np.full(rows * count, error))],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors along the leading components.

    Returns per vector and component: the id, ``component`` (from 1, by falling eigenvalue),
    ``n`` (vectors fitted), ``deviation`` (exact sum of squares of n * x - S, a decimal), ``whitened``,
    ``explained`` (share of the trace) and ``identity_error`` (measured on the whitened rows).
    Vectors that are null, empty or hold null or non-finite entries are left out. Components
    without variance are too: there are at most as many as the covariance has rank, so one
    vector alone, or equal ones, give no rows. Vectors of different lengths are fitted apart.
    Null and repeated ids pass through; other columns are left out; an empty table gives no
    rows. Entries, sums and n * x beyond 63 bits raise an error.
    """
    rows = whole_vectors(vectors, id_col, vec_col)
    fits = fit(rows, components)
    given = rows.select("id", F.size("x").alias("dim"), "x")
    schema = given.select("id").schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"),
                       ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    return given.mapInArrow(_project(fits), schema).withColumnRenamed("id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
