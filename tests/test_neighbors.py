"""Neighbour joins against brute force: duplicates, hot groups, several cells and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions.blocks import Nearest, Within, exact, under
from netloom.functions.distance import METRICS, distance
from netloom.operators import neighbors


def table_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)


def brute_knn(vectors, ids, k, metric, p=2.0):
    out = {}
    for a, x in zip(ids, vectors):
        d = exact(vectors, x[None, :], metric, p)
        ranked = sorted((float(v), int(b)) for v, b in zip(d, ids) if b != a)[:k]
        out[int(a)] = ranked
    return out


def found_knn(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["distance"], r["neighbor_id"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert [b for _, b in got[key]] == [b for _, b in want[key]], key
        assert [d for d, _ in got[key]] == pytest.approx([d for d, _ in want[key]], abs=1e-9)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    clusters = rng.normal(size=(6, 4)) * 8
    spread = clusters[rng.integers(0, 6, 260)] + rng.normal(size=(260, 4))
    hot = np.repeat(np.array([[1.0, 2.0, 3.0, 4.0]]), 130, axis=0)  # a third of all rows are copies
    pairs = np.repeat(rng.normal(size=(5, 4)), 2, axis=0)
    vectors = np.concatenate([spread, hot, pairs])
    ids = rng.permutation(len(vectors)) * 3 + 1
    return vectors, ids


@pytest.mark.parametrize("pivots, block_rows", [(None, 4096), (7, 40), (1, 30)])
def test_knn_blocks(spark, points, pivots, block_rows):
    vectors, ids = points
    df = neighbors.knn(table_of(spark, vectors, ids), 4, pivots=pivots, block_rows=block_rows)
    same(found_knn(df), brute_knn(vectors, ids, 4, "euclidean"))


@pytest.mark.parametrize("metric", METRICS)
def test_knn_metrics(spark, points, metric):
    vectors, ids = points[0][::3], points[1][::3]
    df = neighbors.knn(table_of(spark, vectors, ids), 3, metric, p=3.0, pivots=5, block_rows=25)
    same(found_knn(df), brute_knn(vectors, ids, 3, metric, 3.0))


@pytest.mark.parametrize("pivots, block_rows", [(None, 4096), (6, 10)])
@pytest.mark.parametrize("nonzero", [40, 2, 0])
def test_knn_cosine_zero_vectors(spark, pivots, block_rows, nonzero):
    """Zero vectors are at distance 1 from all rows, one another included; ties go to smaller ids."""
    rng = np.random.default_rng(8)
    vectors = np.concatenate([np.zeros((9, 3)), rng.normal(size=(nonzero, 3)), -np.eye(3)[: min(nonzero, 3)]])
    ids = rng.permutation(len(vectors)) + 5
    df = neighbors.knn(table_of(spark, vectors, ids), 4, "cosine", pivots=pivots, block_rows=block_rows)
    same(found_knn(df), brute_knn(vectors, ids, 4, "cosine"))


@pytest.mark.parametrize("radius", [0.3, 1.0, 0.0])
def test_pairs_within_cosine(spark, radius):
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.normal(size=(60, 3)), np.zeros((1, 3)), np.eye(3)])
    got = neighbors.pairs_within(table_of(spark, vectors), radius, "cosine", pivots=6, block_rows=15).collect()
    want = {}
    for a in range(len(vectors)):
        d = exact(vectors, vectors[a][None, :], "cosine", 2.0)
        want.update({(a, b): d[b] for b in range(a + 1, len(vectors)) if d[b] <= radius})
    assert {(r["id_a"], r["id_b"]): r["distance"] for r in got} == pytest.approx(want)


def test_knn_large_offsets(spark):
    """Values around 1e12 whose differences are small: the matrix product alone would be wrong."""
    rng = np.random.default_rng(4)
    vectors = 1.7e12 + rng.integers(0, 50, size=(120, 3)).astype(float)
    df = neighbors.knn(table_of(spark, vectors), 5)
    same(found_knn(df), brute_knn(vectors, np.arange(120), 5, "euclidean"))


def test_knn_integer_grid_ties(spark):
    vectors = np.array([[x, y] for x in range(9) for y in range(9)], dtype=float)
    df = neighbors.knn(table_of(spark, vectors), 6, pivots=6, block_rows=10)
    same(found_knn(df), brute_knn(vectors, np.arange(81), 6, "euclidean"))


def test_knn_errors(spark):
    df = table_of(spark, np.eye(3))
    with pytest.raises(ValueError):
        neighbors.knn(df, 3)
    with pytest.raises(ValueError):
        neighbors.knn(df, 1, "hamming")
    with pytest.raises(ValueError):
        neighbors.knn(df, 0)
    assert neighbors.knn(df, 2).count() == 6


def test_knn_all_copies(spark):
    vectors = np.ones((20, 2))
    same(found_knn(neighbors.knn(table_of(spark, vectors), 3)), brute_knn(vectors, np.arange(20), 3, "euclidean"))


def test_knn_of(spark, points):
    vectors, ids = points
    df = table_of(spark, vectors, ids)
    want = brute_knn(vectors, ids, 5, "euclidean")[int(ids[7])]
    got = [(r["distance"], r["neighbor_id"]) for r in neighbors.knn_of(df, int(ids[7]), 5).collect()]
    same({0: got}, {0: want})
    with pytest.raises(ValueError):
        neighbors.knn_of(df, -5, 5)
    with pytest.raises(ValueError):
        neighbors.knn_of(table_of(spark, np.eye(3)), 1, 3)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("pivots, block_rows", [(None, 4096), (6, 30)])
def test_pairs_within(spark, points, metric, pivots, block_rows):
    vectors, ids = points
    radius = 2.5
    rows = neighbors.pairs_within(
        table_of(spark, vectors, ids), radius, metric, pivots=pivots, block_rows=block_rows
    ).collect()
    unique, inverse, counts = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    heads = [int(ids[inverse.ravel() == g].min()) for g in range(len(unique))]
    want = {}
    for a in range(len(unique)):
        if counts[a] > 1:
            want[(heads[a], heads[a])] = (0.0, counts[a], counts[a])
        for b in range(len(unique)):
            d = float(exact(unique[a][None, :], unique[b][None, :], metric, 2.0)[0])
            if heads[a] < heads[b] and d <= radius:
                want[(heads[a], heads[b])] = (d, counts[a], counts[b])
    got = {(r["id_a"], r["id_b"]): (r["distance"], r["copies_a"], r["copies_b"]) for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_distance_columns(spark):
    a, b = [1.0, 0.0, -2.0], [4.0, 4.0, 1.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    for metric in METRICS:
        got = row.select(distance(F.col("a"), F.col("b"), metric, 3.0)).first()[0]
        assert got == pytest.approx(float(exact(np.array(a), np.array(b), metric, 3.0)))
    with pytest.raises(ValueError):
        distance(F.col("a"), F.col("b"), "minkowski", 0.5)


def clustered(spark, far=0):
    """600 rows in 12 clusters, of which ``far`` lie a long way off."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 20
    data = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6))
    data[:far] *= 1e4
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vec array<double>")


@pytest.mark.parametrize("far", [0, 9])
def test_far_rows_cost_visits_of_their_own_only(spark, monkeypatch, far):
    seen = []

    def spy(*args):
        rings, visits = second(*args)
        seen.append(visits.groupBy("id").count().toPandas()["count"].to_numpy())
        return rings, visits

    second = neighbors._second_round
    monkeypatch.setattr(neighbors, "_second_round", spy)
    data, df = clustered(spark, far)
    found = neighbors.knn(df, 4, pivots=24, block_rows=50).orderBy("id", "rank").collect()
    apart = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    want = np.argsort(apart, axis=1, kind="stable")[:, :4]
    assert [r["neighbor_id"] for r in found] == want.ravel().tolist()
    # Of 24 cells with 4 rings each a row visits few, far rows elsewhere or not.
    assert np.median(seen[0]) <= 12


def test_approximate_neighbours_and_recall(spark):
    data, df = clustered(spark, 3)
    true = neighbors.knn(df, 5)
    some = neighbors.recall(neighbors.knn_approximate(df, 5, cells=24, probes=4), true).first()
    assert some["neighbors"] == 3000 and some["recall"] >= 0.9
    every = neighbors.recall(neighbors.knn_approximate(df, 5, cells=24, probes=24), true).first()
    assert every["recall"] == 1.0
    few = neighbors.recall(neighbors.knn_approximate(df, 5, cells=200, probes=1), true).first()
    assert few["recall"] < some["recall"]
    unit = neighbors.knn_approximate(df, 3, "cosine", cells=16, probes=6)
    assert neighbors.recall(unit, neighbors.knn(df, 3, "cosine")).first()["recall"] >= 0.8
    with pytest.raises(ValueError):
        neighbors.knn_approximate(df, 5, probes=0)


def test_knn_cosine_in_cells_smaller_than_k(spark):
    """A row whose own cell holds fewer than k others visits other cells all the same."""
    vectors = np.random.default_rng(5).normal(size=(60, 3))
    df = neighbors.knn(table_of(spark, vectors), 8, "cosine", pivots=12, block_rows=10)
    same(found_knn(df), brute_knn(vectors, np.arange(60), 8, "cosine"))


def test_rows_are_copied_by_groups_not_by_blocks(spark, monkeypatch):
    """Small blocks and few pivots: of 4000 rows in all directions each goes to a few groups of cells only."""
    moved = []
    join = neighbors._group_join

    def spy(left, right, *rest):
        moved.append(left.select(F.sum(F.size("groups"))).first()[0])
        return join(left, right, *rest)

    monkeypatch.setattr(neighbors, "_group_join", spy)
    vectors = np.random.default_rng(6).normal(size=(4000, 16))
    got = neighbors.knn(table_of(spark, vectors), 3, pivots=8, block_rows=100).orderBy("id", "rank").collect()
    near = [np.argsort(np.where(np.arange(4000) == i, np.inf, ((vectors - x) ** 2).sum(1)), kind="stable")[:3] for i, x in enumerate(vectors)]
    assert [r["neighbor_id"] for r in got] == np.concatenate(near).tolist()
    # Before: a row stood in as many block pairs as its cell had blocks of 100 rows, on both sides.
    assert sum(moved) <= 4000 * 2 * neighbors.GROUPS


@pytest.mark.parametrize("metric, p", [("euclidean", 2.0), ("cosine", 2.0), ("manhattan", 2.0), ("chebyshev", 2.0), ("minkowski", 3.0), ("minkowski", 2.5)])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e13])
def test_bounds_lose_no_neighbour(metric, p, scale):
    """Bounds in single precision only propose; copies, near copies, zeros and far values among the candidates."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(70, 5)) * scale
    b = np.concatenate([rng.normal(size=(300, 5)) * scale, a[:20], a[:20] * (1 + 1e-9), np.zeros((2, 5)), rng.normal(size=(4, 5)) * scale * 1e6])
    ids, rows, d = rng.permutation(len(b)), np.arange(70), exact(a[:, None], b[None], metric, p)
    search = Nearest(a, b, ids, 4, metric, p)
    for cols in np.array_split(rng.permutation(len(b)), 9):
        search.offer(rows, cols)
    assert all((search.ids[i] == ids[np.lexsort((ids, d[i]))[:4]]).all() for i in rows)
    radius = np.quantile(d, 0.1)
    found = list(Within(a, b, radius, metric, p).pairs(rows, np.arange(len(b))))
    assert sum(len(part[0]) for part in found) == (d <= radius).sum()


def test_neighbouring_pivots_are_compact_groups():
    """Runs of 64 of 1024 pivots on a square are squares, not strips of its whole height."""
    side = np.stack(np.meshgrid(np.arange(32.0), np.arange(32.0)), axis=-1).reshape(-1, 2)
    pivots = neighbors._in_order(np.random.default_rng(1).permutation(side) * [1.0, 0.999], "euclidean")
    assert {tuple(x) for x in pivots} == {tuple(x) for x in side * [1.0, 0.999]}
    spans = [np.ptp(pivots[s : s + 64], axis=0).max() for s in range(0, 1024, 64)]
    assert max(spans) < 20


def test_groups_of_rows_and_of_rings_that_lie_in_several_groups():
    layout = neighbors._Layout.__new__(neighbors._Layout)
    layout.parts, layout.first = np.array([1, 5, 1, 2]), np.array([0, 1, 6, 7])
    layout.group, layout.starts = np.array([0, 0, 1, 2, 3, 4, 4, 4, 5]), np.array([0, 2, 3, 4, 5, 8])
    row, ring = np.array([0, 0, 2, 2, 3]), np.array([0, 2, 1, 3, 3])
    groups = layout.groups_of_rows(row, ring, 5)
    assert [g.tolist() for g in groups] == [[0, 4], [], [0, 1, 2, 3, 4, 5], [4, 5], []]
    assert layout.groups_of(np.array([1])).tolist() == [0, 1, 2, 3, 4]


def test_batches_share_what_is_made_of_the_held_side():
    """Searches of very different sizes among the same rows find what each finds alone."""
    rng = np.random.default_rng(3)
    b, ids = rng.normal(size=(400, 6)), np.arange(400)
    for metric in ("euclidean", "cosine"):
        ready = {}
        for size in (1.0, 1e12, 1e-9, 1.0):
            a = rng.normal(size=(50, 6)) * size
            found = []
            for shared in (ready, None):
                search = Nearest(a, b, ids, 4, metric, 2.0, ready=shared)
                search.offer(np.arange(50), np.arange(400))
                found.append((search.ids, search.distances))
            near = np.sort(exact(a[:, None], b[None], metric, 2.0), axis=1)[:, :4]
            assert (found[0][0] == found[1][0]).all() and np.allclose(found[0][1], near, rtol=1e-12, atol=1e-15)
        assert ready["right"].shape[0] == 400


def test_preparing_the_held_side_takes_little_more_than_its_result():
    """Ten megabytes of held vectors become one more array of that size, without further copies on the way."""
    import tracemalloc

    rng = np.random.default_rng(4)
    b = rng.normal(size=(20_000, 64))
    for metric in ("euclidean", "cosine"):
        b[0] *= 1e3 if metric == "euclidean" else 1.0  # sizes that differ: double precision
        tracemalloc.start()
        Nearest(b[:10].copy(), b, np.arange(len(b)), 5, metric, 2.0)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2 * b.nbytes


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_near_pivots_lose_none(metric, offset):
    """One product tells which pivots are near: also far from the origin, without a bound, and beside empty cells."""
    rng = np.random.default_rng(11)
    pivots, rows = rng.normal(0, 5, (40, 6)) + offset, rng.normal(0, 5, (300, 6)) + offset
    wide, outer, own = rng.uniform(0, 9, 300), rng.uniform(0, 2, 40), rng.integers(0, 40, 300)
    if metric == "cosine":
        wide, outer = wide / (offset + 9), outer / (offset + 9)
    wide[::9], outer[5] = np.inf, -np.inf
    own[own == 5] = 6
    row, cell, lower, upper = neighbors._near_pivots(rows, pivots, wide, outer, own, metric, 2.0)
    x, y = (neighbors.unit(rows), neighbors.unit(pivots)) if metric == "cosine" else (rows, pivots)
    true = neighbors.exact(x[:, None, :], y[None, :, :], "manhattan" if metric == "manhattan" else "euclidean", 2.0)
    wanted = true <= wide[:, None] + outer[None, :]
    wanted[np.arange(300), own], wanted[:, 5] = False, False
    found = np.zeros_like(wanted)
    found[row, cell] = True
    assert not (wanted & ~found).any() and not found[:, 5].any() and not found[np.arange(300), own].any()
    assert (lower <= true[row, cell] * (1 + 1e-9)).all() and (true[row, cell] <= upper * (1 + 1e-9)).all()
    if not offset:
        assert found.sum() == wanted.sum()


def test_copies_are_sorted_by_a_hash(spark):
    """-0.0 and 0.0 are copies, and the sort for them starts with a number, not with the vectors."""
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [5.0, 1.0]), (4, [5.0, 1.5])], "id long, vec array<double>")
    written = []
    keep = neighbors.durable
    try:
        neighbors.durable = lambda table, name: (written.append(table._jdf.queryExecution().optimizedPlan().toString()), keep(table, name))[1]
        got = {(r["id"], r["neighbor_id"]): r["distance"] for r in neighbors.knn(df, 1).collect()}
    finally:
        neighbors.durable = keep
    assert got == {(1, 2): 0.0, (2, 1): 0.0, (3, 4): 0.5, (4, 3): 0.5}
    assert "xxhash64" in written[0] and "lambdafunction(coalesce" not in written[0]


def _exchanged_files(spark):
    """Bytes of the exchanges on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_a_large_join_leaves_no_exchange_on_disk(spark, monkeypatch):
    """Groups take turns: what a turn exchanged is gone when the next begins, and no turn moves much more than asked for."""
    vectors = np.random.default_rng(12).normal(size=(3000, 8))
    df = table_of(spark, vectors)
    moved, left, write, some = [], [], neighbors.durable, neighbors._joined

    def spy_write(table, name):
        out = write(table, name)
        left.append(_exchanged_files(spark))
        return out

    def spy_join(asking, held, blocks, compare, layout):
        groups = F.filter("groups", lambda g: g.isin(*blocks))
        moved.append(asking.select(F.sum(F.size(groups))).first()[0] + sum(layout.held[g] * b for g, b in blocks.items()))
        return some(asking, held, blocks, compare, layout)

    monkeypatch.setattr(neighbors, "durable", spy_write)
    monkeypatch.setattr(neighbors, "_joined", spy_join)
    monkeypatch.setattr(neighbors, "WAVE_BYTES", 0)
    monkeypatch.setattr(neighbors, "WAVE", 1)
    before = _exchanged_files(spark)
    want = brute_knn(vectors, np.arange(3000), 3, "euclidean")
    same(found_knn(neighbors.knn(df, 3, pivots=30, block_rows=100)), want)
    # One group may pass the share: it has at most 3000 / GROUPS rows, visited by at most all.
    assert len(moved) > 6 and max(moved) <= 3000 + 3000 * (1 + 1 / neighbors.GROUPS) + 100
    # Only counts of a few bytes, collected without a write, remain of what was exchanged.
    assert max(left) - before < 100_000


@pytest.mark.parametrize("power", [1, 3])
def test_waves_lie_under_the_power(power):
    u = np.arange(0, 12, 1e-4)  # between two of them a sum of waves bends by less than 1e-6
    assert (u**power - under(u, power)).min() > 1e-6
    assert under(np.array([50.0]), power)[0] < 50.0**power


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e4, 1e12])
@pytest.mark.parametrize("kind", ["plain", "clusters", "grid", "far", "offset", "flat", "copies"])
@pytest.mark.parametrize("metric", ["manhattan", "minkowski", "chebyshev"])
def test_quick_bounds_lose_no_neighbour(metric, kind, scale):
    """Nearest rows of rows that know how far these are at most, with ties, clusters, outliers and features without spread."""
    rng = np.random.default_rng(17)
    b, a = rng.normal(size=(2600, 9)), rng.normal(size=(90, 9))
    if kind == "clusters":
        centres = rng.normal(size=(5, 9)) * 50
        a, b = a * 0.01 + centres[rng.integers(0, 5, 90)], b * 0.01 + centres[rng.integers(0, 5, 2600)]
    if kind == "grid":
        a, b = np.round(a), np.round(b)
    if kind == "far":
        b[:3] *= 1e5
        a[0] *= 1e7
    if kind == "offset":
        a, b = a + 1e5, b + 1e5
    if kind == "flat":
        a[:, 2], b[:, 2], b[:, 5] = 7.0, 3.0, 0.0
    if kind == "copies":
        b[:1500] = b[0]
        a[5] = b[0]
    a, b, ids, ready = a * scale, b * scale, rng.permutation(2600) * 2, {}
    for some in (np.arange(90), np.arange(0, 90, 2)):
        true = np.stack([exact(b, x[None], metric, 3.0) for x in a[some]])
        reach = np.partition(true[:, :300], 4, axis=1)[:, 4] * (1 + 1e-9)
        reach[::11] = np.inf
        search = Nearest(a[some], b, ids, 5, metric, 3.0, reach, ready)
        search.offer(np.arange(len(some)), np.arange(700, 2600))
        search.offer(np.arange(len(some)), np.arange(0, 700))
        for i in range(len(some)):
            order = np.lexsort((ids, true[i]))[:5]
            assert search.ids[i].tolist() == ids[order].tolist()
            assert search.distances[i].tolist() == true[i][order].tolist()


@pytest.mark.parametrize("metric", ["manhattan", "minkowski", "chebyshev"])
def test_few_pairs_without_clusters_are_compared_in_full(metric):
    """Of 200 x 20 000 pairs a few hundred a row, and no tile is summed feature by feature."""
    rng = np.random.default_rng(18)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(20_000, 64))
    true = np.stack([exact(b[:2000], x[None], metric, 3.0) for x in a])
    search = Nearest(a, b, np.arange(20_000), 6, metric, 3.0, np.partition(true, 5, axis=1)[:, 5])
    assert search.bounds.finer is not None
    search.bounds.finer.tile = None  # would fail if it were called
    compared, compare = [], search._compare
    search._compare = lambda i, j: (compared.append(len(i)), compare(i, j))
    search.offer(np.arange(200), np.arange(20_000))
    assert 6 * 200 <= sum(compared) <= 600 * 200


def test_each_task_of_a_join_has_its_own_partition(spark, monkeypatch):
    seen, some = [], neighbors._joined

    def spy(asking, held, blocks, compare, layout):
        out = some(asking, held, blocks, compare, layout)
        seen.append((out.rdd.getNumPartitions(), sum(blocks.values())))
        return out

    monkeypatch.setattr(neighbors, "_joined", spy)
    vectors = np.random.default_rng(19).normal(size=(900, 4))
    same(found_knn(neighbors.knn(table_of(spark, vectors), 3, pivots=12, block_rows=100)), brute_knn(vectors, np.arange(900), 3, "euclidean"))
    assert len(seen) == 2 and all(made == wanted for made, wanted in seen)
