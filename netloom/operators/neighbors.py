"""Exact nearest-neighbour and radius joins.

Every row goes to the cell of its nearest pivot, and a cell's rows lie in rings around it.
For nearest neighbours each row first asks its own cell; the distance found there bounds
which rings of other cells it visits in a second round. Candidates stay where they are:
neighbouring cells are packed into groups of bounded size, one task holds one group, and a
row goes once to every group that has a ring it visits. The task tells again which rings
of its group each row visits and compares it with those only. So rows are copied by the
number of groups, not of cells or of compared blocks. Nothing is capped: a row that
might be an answer is always compared.

For the cosine distance the cells are those of the vectors scaled to length 1, where
it is half the squared Euclidean distance. Zero vectors are at distance 1 from all rows
and take a path of their own.
"""

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.blocks import Nearest, Within, exact, matrix, unit
from netloom.functions.distance import check_metric, distance
from netloom.functions.seeded import uniform
from netloom.plans.sizing import durable, join_small, release

BLOCK_ROWS = 4096
_SLACK = 1 + 1e-9
# On vectors of length 1, differences of cosine distances below rounding errors.
_UNIT_SLACK = 1e-6
_ROUNDING = 1e-12
# A cell's rows lie in rings around its pivot, cut at these shares of them.
RINGS = (0.5, 0.9, 0.99)
# Approximate search: rows that cells are trained on at most, rounds of training, cells a row asks.
TRAIN_ROWS = 65_536
TRAIN_ROUNDS = 6
PROBES = 8
# Bytes of vectors in a group of cells, groups that a small table is cut into, rows of a task that choose their rings together.
GROUP_BYTES, GROUPS, STRIP_ROWS = 32 << 20, 8, 256
# Cells of the held group that rows of a strip may come from, to be compared with the rest of the group together.
MOST_OWN = 8
# Tasks of a join from which on a task takes more visiting rows than a group has rows, up to LONGER times as many.
TASKS, LONGER = 128, 4
# Vectors that a join exchanges at a time: WAVE_BYTES, or WAVE times the table if that is more.
WAVE_BYTES, WAVE = 1 << 30, 3
# Distances to pivots that a task computes at a time.
_STRIP = 500_000


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Ids and vectors. One missing or non-finite value fails the job: it would spoil its whole block."""
    vec = F.col(vec_col).cast("array<double>")
    # Extremes are compiled, a test of each value would be interpreted. NaN is the largest value, and a search for
    # a value that is not there gives NULL if one is missing.
    infinite = F.lit(float("inf"))
    finite = ~F.array_contains(vec, infinite) & (F.array_max(vec) < infinite) & (F.array_min(vec) > -infinite)
    fine = F.coalesce((F.size(vec) == 0) | finite, F.lit(False))
    broken = F.raise_error(F.lit("a vector is missing or holds missing or non-finite values")).cast("array<double>")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.when(fine, vec).otherwise(broken).alias("vec"))


def _pivots(rows: DataFrame, count: int, total: int) -> np.ndarray:
    """A seeded sample of vectors; of ``total`` rows only those with small draws are sorted."""
    draw = uniform(0, "pivot", "id")
    share = 1.5 * count / max(total, 1) + 1e-3
    few = rows.filter(draw < share) if share < 0.5 else rows
    picked = few.orderBy(draw, "id").limit(count).collect()
    if len(picked) < count and share < 0.5:
        picked = rows.orderBy(draw, "id").limit(count).collect()
    return np.array([r["vec"] for r in picked], dtype=float)


def _in_order(pivots: np.ndarray, metric: str) -> np.ndarray:
    """Pivots halved again and again along the direction in which they differ most: runs of neighbouring numbers are compact."""
    if len(pivots) < 3:
        return pivots
    points = unit(pivots) if metric == "cosine" else pivots
    points = points - points.mean(0)
    points = points / max(np.abs(points).max(), 1e-300)

    def halved(some: np.ndarray) -> np.ndarray:
        if len(some) < 3:
            return some
        part = points[some] - points[some].mean(0)
        some = some[np.argsort(part @ np.linalg.svd(part, full_matrices=False)[2][0], kind="stable")]
        return np.concatenate([halved(some[: len(some) // 2]), halved(some[len(some) // 2 :])])

    return pivots[halved(np.arange(len(pivots)))]


def _is_zero(vec) -> Column:
    return F.forall(vec, lambda x: x == 0)


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray, metric: str, p: float) -> tuple:
    """Lower and upper bounds of distances in which the triangle inequality holds: Euclidean ones of unit vectors for cosine.

    Euclidean ones come from a matrix product with its worst-case rounding error.
    """
    if metric == "cosine":
        vectors, pivots, metric = unit(vectors), unit(pivots), "euclidean"
    if metric != "euclidean":
        d = np.stack([exact(vectors, pivot, metric, p) for pivot in pivots], axis=1)
        return d, d
    centre = pivots.mean(0)
    vectors, pivots = vectors - centre, pivots - centre
    squared = (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :]
    error = 4 * (pivots.shape[1] + 8) * np.finfo(float).eps * squared
    squared -= 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squared - error, 0)), np.sqrt(np.maximum(squared + error, 0))


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Number of each row's nearest pivot, up to rounding: squared distances less the row's own square, in one product."""
    if metric == "cosine":
        vectors, pivots, metric = unit(vectors), unit(pivots), "euclidean"
    if metric != "euclidean":
        return np.stack([exact(vectors, pivot, metric, p) for pivot in pivots], axis=1).argmin(1)
    centre = pivots.mean(0)
    pivots = pivots - centre
    less = (vectors - centre) @ (-2 * pivots.T)
    less += (pivots * pivots).sum(1)
    return less.argmin(1)


def _strips(vec: pd.Series, pivots: np.ndarray, metric: str, p: float, most: int = _STRIP):
    """Bounds of distances to all pivots, for some rows (``most`` distances) at a time: (vectors, lower, upper)."""
    step = max(1, most // len(pivots))
    for start in range(0, len(vec), step):
        vectors = np.stack(vec.iloc[start : start + step].to_numpy())
        yield vectors, *_pivot_distances(vectors, pivots, metric, p)


def _cells(rows: DataFrame, pivots, metric, p) -> DataFrame:
    """Adds ``cell`` (that of the nearest pivot, up to rounding) and ``off`` (distance to it)."""
    if len(pivots) == 1:
        return rows.withColumn("cell", F.lit(0)).withColumn("off", F.lit(0.0))

    step = max(1, _STRIP // len(pivots))

    @F.arrow_udf("cell int, off double")
    def assign(vec: pa.Array) -> pa.Array:
        every, cells, offs = matrix(vec), [np.zeros(0, dtype="int32")], [np.zeros(0)]
        for start in range(0, len(every), step):
            vectors = every[start : start + step]
            cell = _nearest_pivots(vectors, pivots, metric, p)
            cells.append(cell.astype("int32"))
            if metric == "cosine":
                offs.append(exact(unit(vectors), unit(pivots)[cell], "euclidean", p))
            else:
                offs.append(exact(vectors, pivots[cell], metric, p))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(offs))], names=["cell", "off"])

    return rows.withColumn("_at", assign("vec")).select(*rows.columns, "_at.*")


def _rho(cells: DataFrame, pivots, k: int, metric, p) -> np.ndarray:
    """Per cell a distance from its pivot within which there are k rows.

    A member at distance u from the pivot has its k neighbours within u + rho.
    """
    closest = Window.partitionBy("cell").orderBy("off", "id")
    rows = (
        cells.select("cell", "off", F.row_number().over(closest).alias("n"))
        .filter(F.col("n") <= k)
        .collect()  # k numbers per pivot
    )
    owner = np.array([r["cell"] for r in rows])
    off = np.array([r["off"] for r in rows])
    if len(off) < k:
        return np.full(len(pivots), np.inf)
    rho = []
    step = max(1, _STRIP // len(off))
    for start in range(0, len(pivots), step):
        _, between = _pivot_distances(pivots[start : start + step], pivots, metric, p)
        rho.append(np.partition(between[:, owner] + off[None, :], k - 1, axis=1)[:, k - 1])
    return np.concatenate(rho)


class _Layout:
    """Rings of all cells, cut into units of bounded size, and groups of neighbouring units.

    Per ring the smallest and largest ``off``; per unit its ring; per group its first unit and about its rows.
    """

    def __init__(self, cells: DataFrame, pivots: np.ndarray, most: int):
        self.pivots, self.width = pivots, (len(RINGS) + 1 if len(pivots) > 1 else 1)
        self.edges = np.full((len(pivots), self.width - 1), np.inf)
        if len(pivots) > 1:
            for r in cells.groupBy("cell").agg(F.percentile_approx("off", list(RINGS)).alias("edges")).collect():
                self.edges[r["cell"]] = r["edges"]
        rings = len(pivots) * self.width
        self.low, self.high, sizes = np.full(rings, np.inf), np.full(rings, -np.inf), np.zeros(rings, dtype=np.int64)
        ringed = _in_rings(cells, self.edges).groupBy("target")
        for r in ringed.agg(F.min("off").alias("low"), F.max("off").alias("high"), F.count(F.lit(1)).alias("n")).collect():
            self.low[r["target"]], self.high[r["target"]], sizes[r["target"]] = r["low"], r["high"], r["n"]
        self.parts = np.maximum(1, -(-sizes // most))
        self.first = np.cumsum(self.parts) - self.parts
        self.ring = np.repeat(np.arange(rings), self.parts)
        self.cell = self.ring // self.width
        unit_sizes, self.starts, filled = np.repeat(-(-sizes // self.parts), self.parts), [0], 0
        for number, size in enumerate(unit_sizes):
            if filled and filled + size > most:
                self.starts.append(number)
                filled = 0
            filled += size
        self.starts = np.array(self.starts)
        self.group = np.searchsorted(self.starts, np.arange(len(self.ring)), side="right") - 1
        self.held = np.add.reduceat(unit_sizes, self.starts)

    def place(self, cells: DataFrame) -> DataFrame:
        """Adds ``unit`` and ``group``."""
        first, parts, group, edges = self.first, self.parts, self.group, self.edges

        @F.pandas_udf("unit int, group int")
        def place(ring: pd.Series, draw: pd.Series) -> pd.DataFrame:
            number = first[ring.to_numpy()] + draw.to_numpy() % parts[ring.to_numpy()]
            return pd.DataFrame({"unit": number.astype("int32"), "group": group[number].astype("int32")})

        rows = _in_rings(cells, edges)
        return rows.withColumn("_at", place("target", F.xxhash64(F.lit("part"), "id"))).select(*rows.columns, "_at.*")

    def groups_of(self, near: np.ndarray) -> np.ndarray:
        """Numbers of the groups that hold any of some rings."""
        return self.groups_of_rows(np.zeros(len(near), dtype=np.int64), near, 1)[0]

    def groups_of_rows(self, row: np.ndarray, near: np.ndarray, rows: int) -> list:
        """The same for each of ``rows`` rows, from pairs of a row and one of its rings."""
        from_, to = self.group[self.first[near]], self.group[self.first[near] + self.parts[near] - 1]
        held = np.zeros((rows, len(self.starts)), dtype=bool)
        while len(row):  # a ring of many rows lies in several groups
            held[row, from_] = True
            more = from_ < to
            row, from_, to = row[more], from_[more] + 1, to[more]
        return np.split(np.nonzero(held)[1].astype("int32"), np.cumsum(held.sum(1))[:-1])


def _in_rings(cells: DataFrame, edges: np.ndarray) -> DataFrame:
    """Adds ``target``, the number of the row's ring among all rings."""
    if not edges.shape[1]:
        return cells.withColumn("target", F.col("cell"))
    width = edges.shape[1] + 1

    @F.pandas_udf("int")
    def ring(cell: pd.Series, off: pd.Series) -> pd.Series:
        own = edges[cell.to_numpy()]
        return pd.Series((cell.to_numpy() * width + (off.to_numpy()[:, None] > own).sum(1)).astype("int32"))

    return cells.withColumn("target", ring("cell", "off"))


def _near_pivots(vectors, pivots, wide, outer, own, metric, p):
    """(row, pivot, lower, upper) of all pairs that may be no farther apart than ``wide`` of the row and ``outer`` of the pivot.

    The pivot ``own`` of a row is left out, as are those whose ``outer`` is -inf. Euclidean pairs are
    told from one matrix product; bounds of distances are made for those found only.
    """
    if metric not in ("euclidean", "cosine"):
        lower, upper = _pivot_distances(vectors, pivots, metric, p)
        near = lower * (1 - _ROUNDING) <= wide[:, None] + outer[None, :]
        near[np.arange(len(vectors)), own] = False
        row, cell = np.nonzero(near)
        return row, cell, lower[row, cell], upper[row, cell]
    if metric == "cosine":
        vectors, pivots = unit(vectors), unit(pivots)
    centre = pivots.mean(0)
    vectors, pivots = vectors - centre, pivots - centre
    products = vectors @ pivots.T
    sizes, others = (vectors * vectors).sum(1), (pivots * pivots).sum(1)
    error = 4 * (pivots.shape[1] + 8) * np.finfo(float).eps
    # No pair is farther apart than this: a row without a bound takes it.
    reach = np.minimum(wide, 2 * (np.sqrt(sizes) + np.sqrt(others.max())))
    span = np.where(np.isfinite(outer), outer, 0.0)
    # (reach + outer)^2 with room for rounding errors, less the squared distance without its own.
    room = (1 + 1e-9) * reach[:, None] * (2 * span)[None, :]
    room += ((1 + 1e-9) * reach * reach - (1 - error) * sizes)[:, None]
    room += np.where(np.isfinite(outer), (1 + 1e-9) * span * span - (1 - error) * others, -np.inf)[None, :]
    room += 2 * products
    near = room >= 0
    near[np.arange(len(vectors)), own] = False
    row, cell = np.nonzero(near)
    both = sizes[row] + others[cell]
    squared = both - 2 * products[row, cell]
    return row, cell, np.sqrt(np.maximum(squared - error * both, 0)), np.sqrt(np.maximum(squared + error * both, 0))


def _visits(asking: DataFrame, layout: _Layout, rho, metric, p) -> DataFrame:
    """Adds ``bound`` and ``groups``: those that hold a ring of another cell where an asking row may have a neighbour.

    ``asking`` has (id, vec, cell, off, bound): no neighbour is farther than ``bound``, NULL
    if the own cell was too small to tell. A ring whose members lie between two distances of
    its pivot cannot come nearer than the row's distance from that pivot allows.
    """
    pivots, width, low, high = layout.pivots, layout.width, layout.low, layout.high
    outer = high.reshape(-1, width).max(1)
    step = max(1, _STRIP // width // len(pivots))

    @F.arrow_udf("bound double, groups array<int>")
    def groups(vec: pa.Array, cell: pa.Array, off: pa.Array, bound: pa.Array) -> pa.Array:
        every, at, own, out = matrix(vec), cell.to_numpy(), off.to_numpy(), []
        reach = np.fmin(bound.to_numpy(zero_copy_only=False).astype(float), own + rho[at])
        wide = _widened(reach, metric)
        for start in range(0, len(every), step):
            rows = slice(start, min(start + step, len(every)))
            row, cells, least, most = _near_pivots(every[rows], pivots, wide[rows], outer, at[rows], metric, p)
            numbers = cells[:, None] * width + np.arange(width)
            gap = _gap(least[:, None], most[:, None], low[numbers], high[numbers])
            i, j = np.nonzero(gap <= wide[rows][row, None])
            out += layout.groups_of_rows(row[i], numbers[i, j], rows.stop - start)
        lists = pa.array(out, pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array(reach), lists], names=["bound", "groups"])

    return asking.withColumn("_to", groups("vec", "cell", "off", "bound")).select("id", "vec", "cell", "off", "_to.*")


def _gap(lower, upper, low, high):
    """How far a row is at least from a ring, if it is from ``lower`` to ``upper`` away from the pivot."""
    return np.maximum(lower * (1 - _ROUNDING) - high, low - upper * (1 + _ROUNDING)) - _ROUNDING * np.where(np.isfinite(high), high, 0)


def _widened(reach: np.ndarray, metric: str) -> np.ndarray:
    """Room for rounding errors."""
    return reach * _SLACK + (_UNIT_SLACK if metric == "cosine" else 0.0)


def _space(reach: np.ndarray, metric: str) -> np.ndarray:
    """A distance between rows as one in the space of the cells, with room for rounding errors."""
    return _widened(np.sqrt(2 * np.maximum(reach, 0)) if metric == "cosine" else reach, metric)


class _Held:
    """The rows of a group in a task, by unit."""

    def __init__(self, batches: list, layout: _Layout):
        table = pa.Table.from_batches(batches)
        units = table["cell"].to_numpy()
        order = np.argsort(units, kind="stable")
        self.vectors, self.ids = matrix(table["vec"])[order], table["id"].to_numpy()[order]
        self.group = int(table["task_group"][0].as_py())
        self.ready = {}  # what comparisons with batch after batch make of the vectors once
        self.units, starts = np.unique(units[order], return_index=True)
        self.edges = np.append(starts, len(order))
        ring = layout.ring[self.units]
        self.cell, self.low, self.high = layout.cell[self.units], layout.low[ring], layout.high[ring]
        self.cells, self.cell_at = np.unique(self.cell, return_inverse=True)

    def rows(self, units) -> np.ndarray:
        return np.concatenate([np.arange(self.edges[u], self.edges[u + 1]) for u in units])

    def gaps(self, vectors, pivots, metric, p) -> np.ndarray:
        """How far each row is at least from each unit."""
        if len(pivots) == 1:
            return np.full((len(vectors), len(self.units)), -np.inf)
        lower, upper = _pivot_distances(vectors, pivots[self.cells], metric, p)
        return _gap(lower[:, self.cell_at], upper[:, self.cell_at], self.low, self.high)


def _nearest_in(held: _Held, batch: pa.RecordBatch, mode: str, layout: _Layout, k: int, metric: str, p: float):
    """(id, other, distance) of the k nearest held rows in the units that the rows of a batch visit."""
    a, cell, off = matrix(batch["vec"]), batch["cell"].to_numpy(), batch["off"].to_numpy()
    bound = batch["bound"].to_numpy(zero_copy_only=False).astype(float)
    if metric == "cosine":  # given as a distance of unit vectors
        bound = bound * bound / 2 + _UNIT_SLACK
    search = Nearest(a, held.vectors, held.ids, k, metric, p, bound * _SLACK, held.ready)
    for start in range(0, len(a), STRIP_ROWS):
        rows = np.arange(start, min(start + STRIP_ROWS, len(a)))
        own = held.cell[None, :] == cell[rows, None]
        if mode == "own":
            gaps = _gap(off[rows, None], off[rows, None], held.low, held.high) if layout.width > 1 else np.full(own.shape, -np.inf)
            gaps = np.where(own, gaps, np.inf)
        elif mode == "listed":
            listed = np.zeros((len(rows), len(layout.pivots)), dtype=bool)
            lists = batch["cells"].slice(start, len(rows))
            listed[np.repeat(np.arange(len(rows)), lists.value_lengths()), lists.flatten().to_numpy()] = True
            gaps = np.where(listed[:, held.cell], held.gaps(a[rows], layout.pivots, metric, p), np.inf)
        else:
            gaps = np.where(own, np.inf, held.gaps(a[rows], layout.pivots, metric, p))

        def offer(u):
            some = rows[(gaps[:, u] <= _space(search.reach[rows], metric)) & (gaps[:, u] < np.inf)]
            if len(some):
                search.offer(some, np.arange(held.edges[u], held.edges[u + 1]))

        order = np.argsort(gaps.min(0), kind="stable")
        # The nearest units come first, until all rows of the strip have a bound: it spares them others.
        while len(order) and np.isinf(search.reach[rows]).any():
            offer(order[0])
            order = order[1:]
        wanted = (gaps[:, order] <= _space(search.reach[rows], metric)[:, None]) & (gaps[:, order] < np.inf)
        # What half of the strip visits (less, if comparing is cheap) is compared with all of it. Rows of a cell of this group,
        # which lie together, take the same without their own.
        common, apart = wanted.mean(0) >= search.common, np.isinf(gaps[:, order])
        here = np.unique(cell[rows][apart.any(1)])
        if mode != "bound" or len(here) > MOST_OWN:
            common &= ~apart.any(0)
            here = here[:0]
        some = np.sort(order[common])
        for home in [None, *here] if common.any() else []:
            at = ~np.isin(cell[rows], here) if home is None else cell[rows] == home
            units = some if home is None else some[held.cell[some] != home]
            if at.any() and len(units):
                search.offer(rows[at], held.rows(units))
        for u in order[wanted.any(0) & ~common]:
            offer(u)
    return [search.found(batch["id"].to_numpy())]


def _within_in(held: _Held, batch: pa.RecordBatch, layout: _Layout, radius: float, metric: str, p: float):
    """Pairs inside the radius, with the smaller id first, a strip at a time. Rows of the same group meet both ways."""
    a, ids, home = matrix(batch["vec"]), batch["id"].to_numpy(), batch["home"].to_numpy()
    search, reach = Within(a, held.vectors, radius, metric, p, held.ready), _space(np.array([radius]), metric)
    for start in range(0, len(a), STRIP_ROWS):
        rows = np.arange(start, min(start + STRIP_ROWS, len(a)))
        wanted = held.gaps(a[rows], layout.pivots, metric, p) <= reach
        common = wanted.mean(0) >= 0.5
        offers = [(rows, held.rows(np.flatnonzero(common)))] if common.any() else []
        offers += [(rows[wanted[:, u]], np.arange(held.edges[u], held.edges[u + 1])) for u in np.flatnonzero(wanted.any(0) & ~common)]
        for some, cols in offers:
            for i, j, d in search.pairs(some, cols):
                x, y = ids[i], held.ids[j]
                keep = (home[i] != held.group) | (x < y)
                yield np.minimum(x, y)[keep], np.maximum(x, y)[keep], d[keep]


_SIDES = "task int, side int, task_group int, id bigint, vec array<double>, cell int, off double, bound double, home int, cells array<int>"


def _group_join(left: DataFrame, right: DataFrame, rows: int, wave: int, compare, layout: _Layout,
                stored=None, spent=()) -> DataFrame:
    """Run ``compare`` on every group and the rows that visit it.

    ``left`` (id, vec, cell, off, ``groups``; bound, home and cells if used) is written already; ``right`` has (id, vec, unit,
    group). At most ``rows`` visiting rows share a task, of a large join up to LONGER times as many, as each task needs a copy
    of its group; they stream past the group, which is held. A join that exchanges more than about ``wave`` rows does so for some
    groups after others and writes what each finds, so disk holds the exchange of some groups only. ``stored`` names
    a result that is to be written anyway. Tables that are ``spent`` then are deleted if the result is written.
    """
    visiting = {r[0]: r[1] for r in left.select(F.explode("groups").alias("g")).groupBy("g").count().collect()}
    groups = len(layout.starts)
    rows = max(rows, min(LONGER * rows, sum(visiting.values()) // TASKS))
    blocks = [max(1, math.ceil(visiting.get(g, 0) / rows)) for g in range(groups)]
    moved = np.cumsum([visiting.get(g, 0) + b * int(layout.held[g]) for g, b in enumerate(blocks)])
    waves = math.ceil(moved[-1] / wave)
    if waves > 1:
        turn = np.minimum((moved - 1) * waves // moved[-1], waves - 1)
        parts = [_joined(left, right, {g: blocks[g] for g in np.flatnonzero(turn == w).tolist()}, compare, layout) for w in np.unique(turn)]
        found = functools.reduce(DataFrame.unionByName, [durable(part, stored or "found") for part in parts])
    else:
        found = _joined(left, right, dict(enumerate(blocks)), compare, layout)
        found = durable(found, stored) if stored else found
    if waves > 1 or stored:
        for table in spent:
            release(table)
    return found


def _joined(left: DataFrame, right: DataFrame, blocks: dict, compare, layout: _Layout) -> DataFrame:
    """The join of some groups, each in so many blocks of visiting rows."""
    first = np.cumsum([0, *blocks.values()])
    counts = left.sparkSession.createDataFrame(
        [(g, int(n), b) for (g, b), n in zip(blocks.items(), first)], "task_group int, first int, blocks int")
    given = lambda name, kind: F.col(name) if name in left.columns else F.lit(None).cast(kind).alias(name)
    draw = F.pmod(F.xxhash64(F.lit("left"), F.col("id")), F.col("blocks")).cast("int")
    a = left.withColumn("task_group", F.explode("groups")).join(F.broadcast(counts), "task_group").select(
        (F.col("first") + draw).alias("task"), F.lit(1).alias("side"), "task_group", "id", "vec", "cell", "off",
        given("bound", "double"), given("home", "int"), given("cells", "array<int>"))
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))
    b = right.withColumnRenamed("group", "task_group").join(F.broadcast(counts), "task_group").select(
        every.alias("task"), F.lit(0).alias("side"), "task_group", "id", "vec", F.col("unit").alias("cell"),
        F.lit(0.0).alias("off"), F.lit(None).cast("double").alias("bound"), F.lit(None).cast("int").alias("home"),
        F.lit(None).cast("array<int>").alias("cells"))

    def run(batches):
        task, parts, held = None, [], None
        for batch in batches:
            tasks, sides = batch["task"].to_numpy(), batch["side"].to_numpy()
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(sides) != 0)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(tasks)]):
                if x == y:
                    continue
                some = batch.slice(x, y - x)
                if tasks[x] != task:
                    task, parts, held = tasks[x], [], None
                if sides[x] == 0:
                    parts.append(some)
                elif parts or held:
                    held = held or _Held(parts, layout)
                    parts = []
                    for ids, others, distances in compare(held, some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(distances, pa.float64())],
                            names=["id", "other", "distance"])

    # Partitions are numbered, not hashed: none is empty while another holds two tasks.
    spread = a.unionByName(b).repartitionById(min(int(first[-1]), 4000), F.col("task"))
    return spread.sortWithinPartitions("task", "side", "cell", "off").mapInArrow(run, _SCHEMA)


def _group_rows(rows: int, width: int, block_rows: int) -> int:
    """Rows of a group: a share of the table between a block and GROUP_BYTES."""
    return max(block_rows, min(GROUP_BYTES // (8 * max(width, 1)), math.ceil(rows / GROUPS)))


def _wave_rows(rows: int, width: int) -> int:
    """Rows that a join exchanges at a time."""
    return max(WAVE_BYTES // (8 * max(width, 1)), WAVE * rows)


def _pivot_count(rows: int, block_rows: int, pivots) -> int:
    """As many cells as rows in a cell, unless one block holds all."""
    if pivots:
        return max(1, min(pivots, rows))
    return 1 if rows <= block_rows else math.ceil(math.sqrt(rows))


_SCHEMA = "id bigint, other bigint, distance double"


def _trained(rows: DataFrame, pivots: np.ndarray, total: int, metric, p) -> np.ndarray:
    """Pivots moved to the means of what is nearest to them in a bounded sample, a few times."""
    sample = _pivots(rows, TRAIN_ROWS, total)
    sample = unit(sample) if metric == "cosine" else sample
    for _ in range(TRAIN_ROUNDS if len(sample) > len(pivots) else 0):
        owner = np.concatenate([d.argmin(1) for _, d, _ in _strips(pd.Series(list(sample)), pivots, metric, p)])
        sums, sizes = np.zeros_like(pivots), np.bincount(owner, minlength=len(pivots))
        np.add.at(sums, owner, sample)
        pivots = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], pivots)
    return pivots


def _probed(asking: DataFrame, layout: _Layout, probes: int, metric, p) -> DataFrame:
    """Adds ``cells``, the own one and others of the nearest pivots, and the ``groups`` that hold them."""
    pivots, width = layout.pivots, layout.width

    @F.pandas_udf("cells array<int>, groups array<int>")
    def nearest_cells(vec: pd.Series, cell: pd.Series) -> pd.DataFrame:
        most, out, groups = min(probes, len(pivots)), [], []
        for _, d, _ in _strips(vec, pivots, metric, p):
            own = cell.to_numpy()[len(out) : len(out) + len(d)]
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            for row, c in zip(near, own):
                row = np.unique(np.append(row, c)).astype("int32")
                out.append(row)
                groups.append(layout.groups_of((row[:, None] * width + np.arange(width)).ravel()))
        return pd.DataFrame({"cells": out, "groups": groups})

    return asking.withColumn("_to", nearest_cells("vec", "cell")).select(*asking.columns, "_to.*")


def _own(asking: DataFrame, layout: _Layout) -> DataFrame:
    """Adds the ``groups`` of the own cell."""
    width = layout.width
    groups = [layout.groups_of(c * width + np.arange(width)) for c in range(len(layout.pivots))]

    @F.pandas_udf("array<int>")
    def own(cell: pd.Series) -> pd.Series:
        return pd.Series([groups[c] for c in cell])

    return asking.withColumn("groups", own("cell"))


def _second_round(placed, asking, found, layout, k, metric, p) -> tuple:
    """Candidates by unit, and the groups that asking rows visit after what they ``found`` in their own cells."""
    rho = _rho(placed, layout.pivots, k + 1, metric, p)
    nearest_ = F.get(F.sort_array(F.collect_list("distance")), F.lit(k))  # k + 1 distances per group of the cell
    bounds = found.groupBy("id").agg(nearest_.alias("bound"))
    if metric == "cosine":  # half the squared distance of unit vectors; greatest() would turn NULL into 0
        bounds = bounds.withColumn("bound", F.when(F.col("bound").isNotNull(), F.sqrt(2 * F.greatest("bound", F.lit(0.0)))))
    visits = _visits(asking.join(bounds, "id", "left"), layout, rho, metric, p)
    return placed, durable(visits.filter(F.size("groups") > 0), "visits")


def knn(df: DataFrame, k: int = 5, metric: str = "euclidean", id_col: str = "id",
        vec_col: str = "vec", p: float = 2.0, block_rows: int = BLOCK_ROWS, pivots=None,
        probes=None) -> DataFrame:
    """The k nearest other rows of every row: ``(id, rank, neighbor_id, distance)``.

    With ``probes`` the search is approximate, see ``knn_approximate``. Ties go to the smaller id. Of a group of exact copies only the k + 1 rows with
    the smallest ids can be neighbours and one stands for all as the asking side,
    so a huge group costs no more than a small one.
    """
    check_metric(metric, p)
    if k < 1:
        raise ValueError("k must be positive")
    base = _vectors(df, id_col, vec_col)
    # Rows are sorted by a hash: Spark makes -0.0 of a vector 0.0 anew for every comparison, now only of equal hashes.
    copies = Window.partitionBy("same", "vec").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    kept = durable(
        base.withColumn("same", F.xxhash64("vec")).withColumns({"copy": F.row_number().over(copies), "head": F.first("id").over(copies)})
        .filter(F.col("copy") <= k + 2).drop("same"),
        "copies",
    )
    sides = kept.agg(
        F.count(F.when(F.col("copy") == 1, 1)).alias("heads"),
        F.count(F.when(F.col("copy") <= k + 1, 1)).alias("others"),
        F.max(F.size("vec")).alias("width"),
    ).first()
    if sides["others"] <= k:
        raise ValueError(f"{sides['others']} rows are too few for k = {k}")
    others = kept.filter(F.col("copy") <= k + 1)
    apart = metric == "cosine" and others.filter(~_is_zero("vec")).limit(1).count() > 0
    celled = others.filter(~_is_zero("vec")) if apart else others
    count = _pivot_count(sides["others"], block_rows, pivots)
    centres = _pivots(celled.select("id", "vec"), count, sides["others"]) if count > 1 else np.zeros((1, 1))
    if probes and count > 1:
        centres = _trained(celled.select("id", "vec"), centres, sides["others"], metric, p)
    centres = _in_order(centres, metric)
    count = len(centres)
    cells = durable(_cells(celled, centres, metric, p), "cells") if count > 1 else _cells(celled, centres, metric, p)
    most = _group_rows(sides["others"], sides["width"], block_rows)
    layout = _Layout(cells, centres, most)
    placed = layout.place(cells)
    asking = cells.filter(F.col("copy") == 1).select("id", "vec", "cell", "off")
    wave = _wave_rows(sides["others"], sides["width"])
    join = lambda left, right, mode, stored=None, spent=(): _group_join(
        left, right, most, wave, lambda held, batch: _nearest_in(held, batch, mode, layout, k + 1, metric, p), layout, stored, spent)
    last = () if apart else (cells,)  # zero vectors meet all rows in the end
    if count > 1 and probes:
        visits = durable(_probed(asking, layout, probes, metric, p), "visits")
        found = join(visits, placed, "listed", None, (visits, *last))
    else:
        found = join(_own(asking, layout), placed, "own", "own-cell" if count > 1 else None)
    if count > 1 and not probes:
        right, visits = _second_round(placed, asking, found, layout, k, metric, p)
        found = found.unionByName(join(visits, right, "bound", None, (visits, *last)))
    if apart:
        # All rows are equally far from a zero vector: at most k + 1 of them count, and they take the smallest ids.
        zeros = others.filter(_is_zero("vec")).select(F.col("id").alias("other"))
        found = found.unionByName(asking.select("id").join(F.broadcast(zeros)).withColumn("distance", F.lit(1.0)))
        zero = others.filter(_is_zero("vec") & (F.col("copy") == 1)).select("id").first()
        if zero:
            first = others.orderBy("id").limit(k + 1).select(F.col("id").alias("other"))
            found = found.unionByName(first.withColumns({"id": F.lit(zero["id"]), "distance": F.lit(1.0)}))
    best = Window.partitionBy("id").orderBy("distance", "other")
    lists = (
        found.withColumn("n", F.row_number().over(best))
        .filter(F.col("n") <= k + 1)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
        .withColumnRenamed("id", "head")
    )
    answers = others.select("id", "head").join(lists, "head").select("id", "near")
    surplus = kept.filter(F.col("copy") == k + 2).select("vec", "head", F.col("id").alias("since"))
    if surplus.limit(1).count():
        hot = durable(surplus.join(lists, "head").drop("head"), "hot-copies")
        more = join_small(base, hot, ["vec"], stored=True)
        answers = answers.unionByName(more.filter("id >= since").select("id", "near"))
    mine = F.slice(F.filter("near", lambda c: c.other != F.col("id")), 1, k)
    return answers.select("id", F.posexplode(mine).alias("pos", "hit")).select(
        F.col("id").alias(id_col),
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.other").alias("neighbor_id"),
        F.col("hit.distance").alias("distance"),
    )


def knn_approximate(df: DataFrame, k: int = 5, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec",
                    p: float = 2.0, cells=None, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``knn`` among the rows of the ``probes`` cells nearest to each row; what lies in other cells is missed.

    Cells (the square root of the rows by default) are trained on a sample of at most
    TRAIN_ROWS rows; every row is in its cell's list. Each row costs ``probes`` cells, whatever
    the data; ``recall`` tells what share of the true neighbours that finds. A row whose cells
    hold fewer than k others gets those. Distances given are exact.
    """
    if probes < 1:
        raise ValueError("probes must be positive")
    return knn(df, k, metric, id_col, vec_col, p, block_rows, cells, probes)


def recall(found: DataFrame, true: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (neighbors, recall): the share of the ``true`` neighbours of all rows that are ``found``.

    Of rows at equal distance any counts, so a found row counts if it is no farther than the
    last true neighbour.
    """
    reach = true.groupBy(id_col).agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_k"))
    near = found.join(reach, id_col).where(F.col("distance") <= F.col("_far") * _SLACK)
    hits = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("_hits"))
    return reach.join(hits, id_col, "left").agg(
        F.sum("_k").alias("neighbors"), (F.coalesce(F.sum("_hits"), F.lit(0)) / F.sum("_k")).alias("recall"))


def knn_of(df: DataFrame, sample_id, k: int = 5, metric: str = "euclidean", id_col: str = "id",
           vec_col: str = "vec", p: float = 2.0) -> DataFrame:
    """The k nearest other rows of one row: ``(neighbor_id, distance)``, a distributed top-k."""
    check_metric(metric, p)
    base = _vectors(df, id_col, vec_col)
    sample = base.filter(F.col("id") == F.lit(sample_id)).limit(1).collect()
    if not sample:
        raise ValueError(f"no row with {id_col} = {sample_id}")
    if base.limit(k + 1).count() <= k:
        raise ValueError(f"too few rows for k = {k}")
    query = F.array(*[F.lit(float(v)) for v in sample[0]["vec"]])
    return (
        base.filter(F.col("id") != F.lit(sample_id))
        .select(F.col("id").alias("neighbor_id"), distance(F.col("vec"), query, metric, p).alias("distance"))
        .orderBy("distance", "neighbor_id")
        .limit(k)
    )


def _reached(placed: DataFrame, layout: _Layout, radius: float, metric, p) -> DataFrame:
    """Adds ``groups``: from the row's own one on, those with rows that may be inside the radius. Earlier groups ask themselves."""
    pivots, low, high, width = layout.pivots, layout.low, layout.high, layout.width
    reach = _space(np.array([radius]), metric)
    last = len(layout.starts)
    held = np.repeat(low <= high, layout.parts)  # units with rows

    @F.pandas_udf("array<int>")
    def groups(vec: pd.Series, home: pd.Series) -> pd.Series:
        out, home = [], home.to_numpy()
        if len(pivots) == 1:
            return pd.Series([np.arange(h, last, dtype="int32") for h in home])
        for _, lower, upper in _strips(vec, pivots, metric, p):
            near = _gap(np.repeat(lower, width, axis=1), np.repeat(upper, width, axis=1), low, high) <= reach
            near = np.repeat(near, layout.parts, axis=1) & held
            any_ = np.logical_or.reduceat(near, layout.starts, axis=1)
            out += [np.flatnonzero(row[h:]).astype("int32") + np.int32(h) for row, h in zip(any_, home[len(out) : len(out) + len(any_)])]
        return pd.Series(out)

    return placed.withColumn("groups", groups("vec", "home")).select("id", "vec", "cell", "off", "home", "groups")


def pairs_within(df: DataFrame, radius: float, metric: str = "euclidean", id_col: str = "id",
                 vec_col: str = "vec", p: float = 2.0, block_rows: int = BLOCK_ROWS,
                 pivots=None) -> DataFrame:
    """All pairwise distances of at most ``radius``: ``(id_a, id_b, distance, copies_a, copies_b)``.

    Exact copies are listed once, under their smallest id, with their number; a
    group of copies appears as the pair of that id with itself.
    """
    check_metric(metric, p)
    groups = durable(
        _vectors(df, id_col, vec_col).groupBy("vec")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    rows = groups.select("id", "vec")
    total, width = groups.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    count = _pivot_count(total, block_rows, pivots)
    if metric == "cosine":
        if radius < 1:  # a zero vector is at distance 1 from all
            rows = rows.filter(~_is_zero("vec"))
        else:  # over half of all pairs are wanted
            count = 1
    centres = _pivots(rows, count, total) if count > 1 else np.zeros((1, 1))
    centres = _in_order(centres, metric) if len(centres) else np.zeros((1, 1))
    cells = _cells(rows, centres, metric, p)
    cells = durable(cells, "cells") if len(centres) > 1 else cells
    most = _group_rows(total, width or 1, block_rows)
    layout = _Layout(cells, centres, most)
    placed = layout.place(cells).withColumn("home", F.col("group"))
    found = _group_join(
        durable(_reached(placed, layout, radius, metric, p), "visits"), placed, most, math.inf,  # its pairs are not stored
        lambda held, batch: _within_in(held, batch, layout, radius, metric, p), layout)
    pairs = found.withColumnsRenamed({"id": "id_a", "other": "id_b"})
    # Only repeated vectors need a lookup; there are often few of them.
    repeated = durable(groups.filter("copies > 1").select("id", "copies"), "repeated")
    for side in ("a", "b"):
        sizes = repeated.select(F.col("id").alias(f"id_{side}"), F.col("copies").alias("_copies"))
        pairs = join_small(pairs, sizes, [f"id_{side}"], "left", stored=True)
        pairs = pairs.withColumn(f"copies_{side}", F.coalesce("_copies", F.lit(1))).drop("_copies")
    pairs = pairs.select("id_a", "id_b", "distance", "copies_a", "copies_b")
    same = groups.filter("copies > 1").select(
        F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
    )
    return pairs.unionByName(same)
