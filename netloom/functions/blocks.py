"""NumPy helpers that compare one block of vectors with another inside a task."""

import numpy as np
import pyarrow as pa

_EPS = np.finfo(np.float64).eps
# Pairs compared at a time: by matrix products, by features.
TILE, SMALL_TILE = 1 << 18, 1 << 15
# Rows of a held side that are prepared at a time.
_STEP = 4096
# Vectors whose sizes differ by no more than this are multiplied in single precision.
_LEVEL = 16


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def exact(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distance of matching rows; the last axis holds the features."""
    if metric == "cosine":
        norms = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norms > 0, 1 - (a * b).sum(-1) / norms, 1.0)
    d = np.abs(a - b)
    if metric == "euclidean":
        return np.sqrt((d * d).sum(-1))
    if metric == "manhattan":
        return d.sum(-1)
    if metric == "chebyshev":
        return d.max(-1)
    return (d**p).sum(-1) ** (1.0 / p)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1; zero vectors stay."""
    sizes = np.sqrt((vectors * vectors).sum(-1, keepdims=True))
    return vectors / np.where(sizes > 0, sizes, 1.0)


def _power_of_two(a, b) -> float:
    """A scale for both sides that brings their values below 1."""
    return _scale_of(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))


def _scale_of(top: float) -> float:
    return 2.0 ** np.ceil(np.log2(top)) if top > 0 else 1.0


def _run(numbers: np.ndarray):
    """A slice if the numbers follow one another: its rows need no copy."""
    whole = len(numbers) and numbers[-1] - numbers[0] == len(numbers) - 1 and (np.diff(numbers) == 1).all()
    return slice(numbers[0], numbers[-1] + 1) if whole else numbers


class _Products:
    """Lower bounds of Euclidean (squared) and cosine distances: one matrix product with its worst-case rounding error inside.

    Vectors of like sizes, those of the cosine among them, are multiplied in single precision. ``ready`` keeps
    what is made of ``b`` alone for the next ``a``.
    """

    strip, tile_size = 256, TILE

    def __init__(self, a, b, metric, ready):
        self.euclidean = metric == "euclidean"
        one = lambda x: np.ones((len(x), 1))
        level = True
        if self.euclidean:
            if "centre" not in ready:
                ready["centre"] = b.mean(0)
                ready["top"] = max(np.abs(b[s : s + _STEP] - ready["centre"]).max(initial=0) for s in range(0, len(b), _STEP))
            a = a - ready["centre"]
            self.scale = _scale_of(max(np.abs(a).max(initial=0), ready["top"]))
            a /= self.scale
            if ready.get("scale") != self.scale:
                steps = range(0, len(b), _STEP)
                others = [np.square((b[s : s + _STEP] - ready["centre"]) / self.scale).sum(1) for s in steps]
                ready.update(scale=self.scale, others=np.concatenate(others), kind=None)
            self.sizes, self.others = (a * a).sum(1), ready["others"]
            sizes = np.concatenate([self.sizes, self.others])
            level = sizes.max() <= _LEVEL * np.median(sizes)
        kind = np.float32 if level else np.float64
        self.slack = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps)
        if ready.get("kind") != kind:
            # Filled a step at a time: no second copy of the held rows.
            width = b.shape[1]
            right = np.ones((len(b), width + (2 if self.euclidean else 1)), kind)
            right[:, -1] = (1 - self.slack) * self.others if self.euclidean else 1 - self.slack
            for s in range(0, len(b), _STEP):
                part = b[s : s + _STEP]
                right[s : s + _STEP, :width] = (part - ready["centre"]) / self.scale if self.euclidean else unit(part)
            ready.update(kind=kind, right=right)
        left = [-2 * a, (1 - self.slack) * self.sizes[:, None], one(a)] if self.euclidean else [-unit(a), one(a)]
        self.left, self.right = np.concatenate(left, axis=1).astype(kind), ready["right"]

    def tile(self, rows, cols):
        return self.left[_run(rows)] @ self.right[_run(cols)].T

    def limit(self, rows, cols, reach):
        """What a tile's value is at most if the distance is at most ``reach``."""
        with np.errstate(over="ignore"):
            most = (reach / self.scale) ** 2 * (1 + self.slack) if self.euclidean else reach
            return np.nextafter(most.astype(self.left.dtype), self.left.dtype.type(np.inf))

    def upper(self, rows, cols, value):
        """A distance that the pairs of a value do not pass."""
        value = value.astype(float)
        if not self.euclidean:
            return value + 2 * self.slack
        most = value + 2 * self.slack * (self.sizes[rows] + self.others[cols].max())
        return np.sqrt(np.maximum(most, 0)) * (1 + self.slack) * self.scale


class _Sums:
    """Sums (or maxima) over the features in single precision, a feature at a time, with their worst-case rounding error.

    Both sides are scaled by one power of two, so that nothing overflows; what underflows is part of the error.
    """

    strip, tile_size = 64, SMALL_TILE

    def __init__(self, a, b, metric, p):
        self.rows = None
        self.power = int(p) if metric == "minkowski" else 1
        self.largest = metric == "chebyshev"
        centre = b.mean(0)
        a, b = a - centre, b - centre
        self.scale = _power_of_two(a, b)
        a, b = a / self.scale, b / self.scale
        zero = np.zeros(a.shape[1])
        width = max(a.shape[1], 1)
        factor = (width + 4 * self.power + 8) * float(np.finfo(np.float32).eps)
        least = (width * 4 * float(np.finfo(np.float32).tiny)) ** (1 / self.power)
        self.error = factor * exact(a, zero, metric, p) + least
        self.other_error = factor * exact(b, zero, metric, p)
        self.left, self.right = np.ascontiguousarray(a.T, np.float32), np.ascontiguousarray(b.T, np.float32)

    def tile(self, rows, cols):
        if rows is not self.rows or self.wide.shape[2] < len(cols):
            # Each value of a row stands as often as there are columns: equal strides are subtracted faster.
            self.rows, self.wide = rows, np.repeat(np.take(self.left, rows, axis=1)[:, :, None], len(cols), axis=2)
        total = np.zeros((len(rows), len(cols)), np.float32)
        part, whole = np.empty_like(total), np.empty_like(total)
        for x, y in zip(self.wide, np.take(self.right, cols, axis=1)):
            np.subtract(x[:, : len(cols)], y[None, :], out=part)
            np.abs(part, out=part)
            if self.largest:
                np.maximum(total, part, out=total)
                continue
            factors = part
            for _ in range(self.power - 1):
                factors = np.multiply(factors, part, out=whole)
            np.add(total, factors, out=total)
        return total

    def _room(self, rows, cols):
        return self.error[rows] + self.other_error[cols].max()

    def limit(self, rows, cols, reach):
        most = (reach / self.scale + self._room(rows, cols)) ** self.power * (1 + 1e-6)
        with np.errstate(over="ignore"):
            return np.nextafter(most.astype(np.float32), np.float32(np.inf))

    def upper(self, rows, cols, value):
        return (value.astype(float) ** (1 / self.power) * (1 + 1e-6) + self._room(rows, cols)) * self.scale


# By power p: half period, and the numbers of a + b u^2 - sum(c cos(m pi u / period)) with the multiples m. Nowhere above |u|^p.
_UNDER = {
    1: (2.3, 1.10986, 0.0, ((1, 0.93433), (3, 0.11105), (5, 0.06449))),
    3: (2.4, -3.6547, 3.65651, ((1, -3.61084),)),
}
# What the k-th neighbour's mean |u|^p is about, if differences u are of standard deviation 1: it sets the scale.
_NEAR = {1: 0.55, 3: 0.6}


def under(u: np.ndarray, power: int) -> np.ndarray:
    """A sum of products of functions of x and of y, where u = x - y, that is at most |u|^power."""
    period, first, square, waves = _UNDER[power]
    return first + square * u * u - sum(c * np.cos(m * np.pi / period * u) for m, c in waves)


class _Waves:
    """Lower bounds of sums of |x - y|^p over the features: ``under`` is one matrix product, with its worst-case rounding error inside.

    A feature's scale follows its spread and the distances asked for, in powers of two. ``ready`` keeps what
    is made of ``b`` at a scale. ``finer`` compares what the bound does not tell apart.
    """

    strip, tile_size, least, common = 256, TILE, 512, 0.125

    def __init__(self, a, b, power, reach, ready, finer):
        self.power, self.finer, self.dense = power, finer, 6
        if "spread" not in ready:
            ready["centre"] = b.mean(0)
            squares = sum(np.square(b[s : s + _STEP] - ready["centre"]).sum(0) for s in range(0, len(b), _STEP))
            ready["spread"] = np.sqrt(2 * squares / len(b))
        spread = ready["spread"]
        self.used = np.flatnonzero(spread > 1e-9 * spread.max(initial=0))
        wide, known = spread[self.used], reach[np.isfinite(reach) & (reach > 0)]
        share = (np.median(known) ** power / (_NEAR[power] * (wide**power).sum())) ** (1 / power) if len(known) and len(wide) else 1.0
        scale = wide * 2.0 ** np.ceil(np.log2(min(share, 1.0))) if share > 0 else wide
        top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
        # Outside these sizes single precision would overflow.
        self.fit = len(scale) > 0 and scale.min() > 1e-9 and top < 1e9 and top / scale.min() < 1e6
        if not self.fit:
            return
        self.left, self.sizes, self.more = self._made(a, ready["centre"], scale, True)
        if ready.get("scale") is None or not np.array_equal(ready["scale"], scale):
            ready.update(scale=scale, right=self._made(b, ready["centre"], scale, False))
        self.right, self.other_sizes, self.other_more = ready["right"]
        self.first = _UNDER[power][1] * (scale**power).sum()
        self.slack = 4 * (self.left.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def _made(self, vectors, centre, scale, asking: bool):
        """Factors in single precision, their lengths, and per row what rounding of the arguments may change."""
        period, _, square, waves = _UNDER[self.power]
        weight, width = scale ** (self.power / 2), len(scale)
        out = np.ones((len(vectors), width * (2 * len(waves) + bool(square)) + bool(square)), np.float32)
        sizes, more = np.empty(len(vectors)), np.empty(len(vectors))
        if asking:
            self.own = np.zeros(len(vectors))
        for start in range(0, len(vectors), _STEP):
            some = slice(start, start + _STEP)
            u = (vectors[some][:, self.used] - centre[self.used]) / scale
            turn, at = np.exp(1j * np.pi / period * u), 0
            for m, c in waves:
                part = turn**m * (np.sqrt(abs(c)) * weight)
                sign = -np.sign(c) if asking else 1.0
                out[some, at : at + width], out[some, at + width : at + 2 * width] = sign * part.real, sign * part.imag
                at += 2 * width
            if square:
                size = square * ((weight * u) ** 2).sum(1)
                out[some, at : at + width] = (-2 if asking else 1) * square ** (1 if asking else 0) * weight * u
                if asking:
                    self.own[some] = size
                else:
                    out[some, -1] = size
            sizes[some] = np.sqrt(np.square(out[some].astype(float)).sum(1))
            turned = sum(abs(c) * m for m, c in waves) * np.pi / period
            more[some] = 64 * _EPS * ((turned + 1) * weight**2 * (1 + np.abs(vectors[some][:, self.used] / scale) + np.abs(centre[self.used] / scale)) ** (2 if square else 1)).sum(1)
        return out, sizes, more

    def tile(self, rows, cols):
        return self.left[_run(rows)] @ self.right[_run(cols)].T

    def limit(self, rows, cols, reach):
        cols = _run(cols)
        room = self.slack * self.sizes[rows] * self.other_sizes[cols].max() + self.more[rows] + self.other_more[cols].max()
        with np.errstate(over="ignore"):
            most = reach**self.power * (1 + 1e-9) - self.first - self.own[rows] + room + 1e-12 * (abs(self.first) + self.own[rows])
            return np.nextafter(most.astype(np.float32), np.float32(np.inf))


class _Ranges:
    """Pairs that differ by no more than a reach in every feature, from one bit a pair, feature and level.

    ``ready`` keeps, of each feature of ``b``, sets of the rows up to each of LEVELS levels, a block of rows at a time.
    """

    strip, least, common, LEVELS, BLOCK = 256, 1024, 0.125, 64, 8192

    def __init__(self, a, b, ready, finer):
        self.a, self.b, self.finer, self.ready = a, b, finer, ready
        if "edges" not in ready:
            some = b[:: max(1, len(b) // 16384)]
            ready["edges"] = np.quantile(some, np.arange(1, self.LEVELS) / self.LEVELS, axis=0, method="lower").T.copy()

    def _levels(self, values):
        """Of each feature the number of edges below a value, by feature."""
        return np.stack([np.searchsorted(edges, v) for edges, v in zip(self.ready["edges"], values.T)])

    def _sets(self, block):
        """By feature and level: rows of the block whose level is lower, a bit each."""
        if block not in self.ready:
            levels = self._levels(self.b[block * self.BLOCK : (block + 1) * self.BLOCK])
            sets = np.zeros((len(levels), self.LEVELS + 1, self.BLOCK // 64), np.uint64)
            for own, level in zip(sets.view(np.uint8), levels):
                lower = np.zeros((self.LEVELS + 1, self.BLOCK), bool)
                lower[:, : len(level)] = level < np.arange(self.LEVELS + 1)[:, None]
                own[:] = np.packbits(lower, axis=1, bitorder="little")
            self.ready[block] = sets
        return self.ready[block]

    def chunks(self, rows, cols):
        blocks = np.unique(cols // self.BLOCK)
        for start in range(0, len(rows), self.strip):
            for block in blocks:
                yield rows[start : start + self.strip], block

    def close(self, rows, block, cols, reach):
        """(row, column) of the pairs in a block."""
        sets, values = self._sets(block), self.a[rows]
        room = (reach * (1 + 1e-12))[:, None] + 4 * _EPS * np.abs(values)
        upto, below = self._levels(values + room) + 1, self._levels(values - room)
        wanted = np.zeros(self.BLOCK, bool)
        wanted[cols[cols // self.BLOCK == block] - block * self.BLOCK] = True
        left = np.repeat(np.packbits(wanted, bitorder="little").view(np.uint64)[None], len(rows), axis=0)
        part, lower = np.empty_like(left), np.empty_like(left)
        for own, top, bottom in zip(sets, upto, below):
            np.take(own, top, axis=0, out=part, mode="clip")
            np.take(own, bottom, axis=0, out=lower, mode="clip")
            np.bitwise_xor(part, lower, out=part)
            np.bitwise_and(left, part, out=left)
        row, word = np.nonzero(left)
        at, bit = np.nonzero(np.unpackbits(left[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return rows[row[at]], block * self.BLOCK + word[at] * 64 + bit


class _Direct:
    """The distances themselves."""

    strip, tile_size = 256, TILE

    def __init__(self, a, b, metric, p):
        self.a, self.b, self.how = a, b, (metric, p)

    def tile(self, rows, cols):
        a, b = self.a[rows], self.b[cols]
        step = max(1, TILE // max(b.size, 1))
        parts = [exact(a[s : s + step, None, :], b[None, :, :], *self.how) for s in range(0, len(a), step)]
        return np.concatenate(parts)

    def limit(self, rows, cols, reach):
        return reach * (1 + 1e-12)

    def upper(self, rows, cols, value):
        return value


def _bounds(a, b, metric: str, p: float, ready=None):
    if metric in ("euclidean", "cosine"):
        return _Products(a, b, metric, {} if ready is None else ready)
    if metric != "minkowski" or p in (1, 2, 3, 4):
        return _Sums(a, b, metric, p)
    return _Direct(a, b, metric, p)


def _chunks(bounds, rows, cols):
    """Strips of rows with chunks of columns."""
    for r in range(0, len(rows), bounds.strip):
        some = rows[r : r + bounds.strip]
        step = max(1, bounds.tile_size // len(some))
        for c in range(0, len(cols), step):
            yield some, cols[c : c + step]


def _hits(value, limit):
    return np.divmod(np.flatnonzero((value <= limit[:, None]).ravel()), max(value.shape[1], 1))


def _exact_pairs(a, b, i, j, metric, p):
    """Distances of the pairs (i, j), a bounded number of values at a time."""
    step = max(1, 2_000_000 // max(a.shape[1], 1))
    parts = [exact(a[i[s : s + step]], b[j[s : s + step]], metric, p) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Nearest:
    """The ``k`` nearest of what some rows ``a`` have been offered so far, by (distance, id).

    ``reach`` is per row a distance beyond which nothing counts; it falls to that of the k-th found.
    Searches among the same ``b`` may share ``ready``, an empty dictionary at first.
    """

    def __init__(self, a, b, b_ids, k: int, metric: str, p: float, reach=None, ready=None):
        self.a, self.b, self.b_ids, self.k, self.how = a, b, b_ids, k, (metric, p)
        self.reach = np.full(len(a), np.inf) if reach is None else np.where(np.isnan(reach), np.inf, reach)
        self.distances = np.full((len(a), k), np.inf)
        self.ids = np.full((len(a), k), np.iinfo(np.int64).max)
        self.bounds = _bounds(a, b, metric, p, ready)
        # Sums are told apart faster where most rows know a reach and there are many to compare with.
        quick = isinstance(self.bounds, _Sums) and len(b) >= _Waves.least and np.isfinite(self.reach).mean() > 0.5
        ready = {} if ready is None else ready
        if quick and metric == "chebyshev":
            self.bounds = _Ranges(a, b, ready, self.bounds)
        elif quick and self.bounds.power in _UNDER:
            waves = _Waves(a, b, self.bounds.power, self.reach, ready, self.bounds)
            self.bounds = waves if waves.fit else self.bounds

        # Share of some rows that must ask for a column for all of them to be compared with it.
        self.common = getattr(self.bounds, "common", 0.5)

    def offer(self, rows: np.ndarray, cols: np.ndarray):
        """Compare rows of ``a`` with rows of ``b``, a bounded number of pairs at a time. No pair may come twice."""
        if isinstance(self.bounds, (_Waves, _Ranges)):
            fresh = np.isinf(self.reach[rows]) | (len(cols) < self.bounds.least)
            self._offer(self.bounds.finer, rows[fresh], cols)
            (self._offer_ranges if isinstance(self.bounds, _Ranges) else self._offer_waves)(rows[~fresh], cols)
        else:
            self._offer(self.bounds, rows, cols)

    def _offer_waves(self, rows, cols):
        for rows, some in _chunks(self.bounds, rows, cols):
            value = self.bounds.tile(rows, some)
            i, j = _hits(value, self.bounds.limit(rows, some, self.reach[rows]))
            if len(i) > value.size // self.bounds.dense:
                self._offer(self.bounds.finer, rows, some)
            elif len(i):
                self._compare(rows[i], some[j])

    def _offer_ranges(self, rows, cols):
        for rows, block in self.bounds.chunks(rows, cols):
            i, j = self.bounds.close(rows, block, cols, self.reach[rows])
            if len(i):
                self._compare(i, j)

    def _compare(self, i, j):
        d = _exact_pairs(self.a, self.b, i, j, *self.how)
        keep = d <= self.reach[i]
        self._merge(i[keep], self.b_ids[j[keep]], d[keep])

    def _offer(self, bounds, rows, cols):
        for rows, some in _chunks(bounds, rows, cols):
            value, reach = bounds.tile(rows, some), self.reach[rows]
            fresh = np.flatnonzero(np.isinf(reach))
            if len(fresh) and len(some) >= self.k:
                kth = np.partition(value[fresh], self.k - 1, axis=1)[:, self.k - 1]
                reach[fresh] = bounds.upper(rows[fresh], some, kth)
            i, j = _hits(value, bounds.limit(rows, some, reach))
            if len(i) > max(value.size // 32, 3 * self.k * len(rows)) and len(some) >= self.k:
                # The tile itself tells a shorter reach, which costs less than that many distances.
                kth = np.partition(value, self.k - 1, axis=1)[:, self.k - 1]
                reach = np.minimum(reach, bounds.upper(rows, some, kth))
                i, j = _hits(value, bounds.limit(rows, some, reach))
            if len(i):
                self._compare(rows[i], some[j])

    def _merge(self, i, ids, d):
        touched = np.unique(i)
        i = np.concatenate([i, np.repeat(touched, self.k)])
        d = np.concatenate([d, self.distances[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, d, i))
        i, d, ids = i[order], d[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep = place < self.k
        self.distances[i[keep], place[keep]] = d[keep]
        self.ids[i[keep], place[keep]] = ids[keep]
        self.reach[touched] = np.minimum(self.reach[touched], self.distances[touched, self.k - 1])

    def found(self, a_ids):
        i, place = np.nonzero(np.isfinite(self.distances))
        return a_ids[i], self.ids[i, place], self.distances[i, place]


class Within:
    """Pairs at a distance of at most ``radius``, as (row of a, row of b, distance)."""

    def __init__(self, a, b, radius: float, metric: str, p: float, ready=None):
        self.a, self.b, self.how = a, b, (metric, p)
        self.reach = np.full(len(a), float(radius))
        self.bounds = _bounds(a, b, metric, p, ready)

    def pairs(self, rows: np.ndarray, cols: np.ndarray):
        for rows, some in _chunks(self.bounds, rows, cols):
            i, j = _hits(self.bounds.tile(rows, some), self.bounds.limit(rows, some, self.reach[rows]))
            if len(i):
                i, j = rows[i], some[j]
                d = _exact_pairs(self.a, self.b, i, j, *self.how)
                keep = d <= self.reach[i]
                yield i[keep], j[keep], d[keep]
