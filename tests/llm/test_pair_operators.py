"""Top-k search, near-duplicate joins, components and the pipeline on small tables."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import block_topk, caps, forest, graph
from tests.llm.cases import awkward, docs, empty, words

VECTORS = "vec_id long, embedding array<float>, label int, vec string, rep string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "x", "x") for i, v, l in rows], VECTORS)


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ---------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    edges += [(5000, 5001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_edges_connect_the_same_nodes():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, (2, 300))
    x, y = graph.star_edges(a, b)
    nodes = set(a.tolist()) | set(b.tolist())
    assert roots(nodes, zip(a.tolist(), b.tolist())) == roots(nodes, zip(x.tolist(), y.tolist()))
    assert len(x) < len(nodes)


def test_stars_of_a_matrix():
    linked = np.zeros((6, 6), dtype=bool)
    for i, j in ((0, 3), (3, 5), (1, 2)):
        linked[i, j] = linked[j, i] = True
    assert graph.stars(linked).tolist() == [0, 1, 1, 0, 4, 0]


# --- near-duplicate documents ---------------------------------------------------


def shingle_set(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_links(texts, least=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    out = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            out.append((a, b))
    return out


def near_texts():
    rng = random.Random(3)
    out, passage = [], words(30, 99)
    for g in range(25):
        base = words(rng.randint(3, 120), g).split()
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 45])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(1, rng.random())
            out.append((" ".join(copy)).title() + rng.choice(["", "!", " - "]))
        out.append(passage + " " + words(rng.randint(5, 80), 1000 + g))
    return out + ["", "...", "Été à Zürich × 5", "été à zürich 5"]


def test_forest_against_brute_force(spark):
    texts = dict(enumerate(near_texts()))
    got = {r["doc_id"]: r for r in forest.near_duplicates(docs(spark, list(texts.values()))).collect()}
    links = brute_links(texts)
    component = roots(texts, links)
    for i in texts:
        assert got[i]["n_links"] == sum(i in l for l in links), i
        assert got[i]["component_id"] == component[i] and got[i]["kept"] == (component[i] == i)
        same = [j for j in texts if shingle_set(texts[j]) and re.findall(r"[^\W_]+", texts[j].lower()) == re.findall(r"[^\W_]+", texts[i].lower())]
        assert got[i]["class_id"] == (min(same) if same else i)


def test_forest_in_blocks(spark, monkeypatch):
    """Groups cut into many blocks give the same links."""
    table = docs(spark, near_texts())
    want = sorted(map(tuple, forest.near_duplicates(table).select("doc_id", "n_links", "component_id").collect()))
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(forest, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(forest, "VERIFY_ROWS", 9)
    got = sorted(map(tuple, forest.near_duplicates(table).select("doc_id", "n_links", "component_id").collect()))
    assert got == want


def test_lines_that_differ_in_one_word_stay_within_memory():
    """Rows of five shingles, alike but no copies: blocks are bounded in rows, edges of a node in number."""
    texts = pa.array([f"w{i} shared line of exactly nine plain words here" for i in range(2 * forest.VERIFY_ROWS)])
    values, runs = forest.shingles(*forest.word_hashes(texts))
    sets = np.sort(values.reshape(len(texts), -1)).view(np.int64)
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({
        "comp": np.zeros(n, np.int64), "bi": np.zeros(n, np.int32), "bj": np.zeros(n, np.int32), "side": np.zeros(n, np.int32),
        "rep": np.arange(n), "copies": np.ones(n, np.int64), "set": pa.array(list(sets))})
    tracemalloc.start()
    found = pa.Table.from_batches(forest._verified(0.6)([batch])).to_pydict()
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 256, (1, forest.SKETCH), dtype=np.uint8).repeat(2 * forest.BLOCK_ROWS, 0)
    differ = rng.random(sketch.shape) < 0.2
    sketch[differ] = rng.integers(0, 256, differ.sum(), dtype=np.uint8)
    edges = forest._led(sketch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(l == n - 1 for l in found["links"]) == n and sum(o is not None for o in found["other"]) == n - 1
    assert len(graph.star_edges(*edges)[0]) == 2 * forest.BLOCK_ROWS - 1
    assert peak < 300 << 20


def test_leaders_connect_alike_rows():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (3, forest.SKETCH), dtype=np.uint8)
    rows = np.repeat(base, 40, 0)
    noise = rng.random(rows.shape) < 0.03
    rows[noise] = rng.integers(0, 256, noise.sum())
    edges = forest._led(rows)
    found = roots(range(120), edges.T.tolist())
    assert len(set(found.values())) == 3 and edges.shape[1] < 120 * 8


def test_depths_reach_the_recall():
    use = forest.depths()
    miss = np.prod([1 - forest.SIMILARITY**d for d in use])
    longer = sorted(use)[:-1] + [max(use) + 1]
    assert miss <= 1 - forest.RECALL and len(use) == forest.TREES and max(use) - min(use) <= 1
    one_up = list(use)
    one_up[use.index(min(use))] += 1
    assert np.prod([1 - forest.SIMILARITY**d for d in one_up]) > 1 - forest.RECALL and longer


def test_forest_awkward(spark):
    table = awkward(spark)
    out = forest.near_duplicates(table)
    assert out.count() == 13
    kept = forest.keep_one(table)
    assert kept.columns == table.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == 10 and sum(t is None for t in texts) == 2  # three of the four alike go
    assert forest.near_duplicates(empty(spark)).count() == 0 and forest.keep_one(empty(spark)).count() == 0


# --- near-duplicate embeddings --------------------------------------------------


def noisy(rng, base, cosine):
    other = rng.normal(size=len(base))
    other -= other @ base * base
    other /= np.linalg.norm(other)
    return cosine * base + np.sqrt(1 - cosine**2) * other


def test_caps_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        base = rng.normal(size=32)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.choice([1, 2, 4, 30]))):
            rows.append((len(rows), (noisy(rng, base, rng.uniform(0.95, 1.0)) * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(g % 3)))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(3)]
    rows += [(len(rows), rows[0][1], None), (len(rows) + 1, [0.0] * 32, 0), (len(rows) + 2, None, 0), (len(rows) + 3, [], 0),
             (len(rows) + 4, [float("nan")] * 32, 0), (len(rows) + 5, [None] * 32, 0), (len(rows) + 6, [1.0, 2.0], 0), (len(rows) + 7, [2.0, 4.0], 0)]
    got = {r["vec_id"]: r for r in caps.near_duplicates(vectors(spark, rows)).collect()}
    links = []
    fine = {}
    for i, v, l in rows:
        x = np.array([np.nan if c is None else c for c in v or []], dtype=float)
        if l is not None and len(x) and np.isfinite(x).all() and x.any():
            fine[i] = (l, x / np.linalg.norm(x))
    for a, b in itertools.combinations(fine, 2):
        if fine[a][0] == fine[b][0] and len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] >= 0.93:
            links.append((a, b))
    component = roots([r[0] for r in rows], links)
    assert len(links) > 500
    for i, _, _ in rows:
        assert got[i]["n_links"] == sum(i in l for l in links)
        assert got[i]["component_id"] == component[i] and got[i]["kept"] == (component[i] == i)


def test_list_decoding_finds_all_exceeding_filters():
    rng = np.random.default_rng(2)
    code = caps.CapCode(24, 500, shared=6.0)
    unit = rng.normal(size=(50, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = set(zip(*[x.tolist() for x in code.decode(unit)]))
    choices = list(itertools.product(range(code.size), repeat=len(code.codes)))
    directions = np.array([np.concatenate([c[i] for c, i in zip(code.codes, pick)]) for pick in choices])
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    over = (unit @ code.rotation) @ directions.T >= code.least
    assert got == set(zip(*[x.tolist() for x in np.nonzero(over)])) and over.any()


@pytest.mark.parametrize("dim, count", [(64, 1_000), (64, 100_000), (64, 1_000_000), (8, 100_000), (2, 1_000_000)])
def test_caps_recall_at_the_cosine(dim, count):
    """Pairs right at the cosine meet in a filter, however many rows the code is made for."""
    rng = np.random.default_rng(9)
    codes, lost = caps.codes_for(dim, count), 0
    for _ in range(3):
        one = rng.normal(size=(1000, dim))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        two = np.array([noisy(rng, x, 0.9301) for x in one])
        met = np.zeros(1000, dtype=bool)
        for code in codes:
            a, b = (set(zip(*[x.tolist() for x in code.decode(v)])) for v in (one, two))
            met[[row for row, _ in a & b]] = True
        lost += (~met).sum()
    assert lost <= 3  # 0.3 are expected at most


def test_cap_shares_are_spherical():
    """Three components have uniform inner products, two have uniform angles; 64 against a sample."""
    assert np.allclose(caps._tail([0.9, 0.0, -0.5], 3), [0.05, 0.5, 0.75], atol=1e-6)
    assert np.isclose(caps._tail(np.cos(0.3), 2), 0.3 / np.pi, atol=1e-6)
    x = np.random.default_rng(3).normal(size=(400_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.isclose((x[:, 0] > 0.35).mean(), caps._tail(0.35, 64), rtol=0.1)
    near = 0.93 * x[:, 0] + np.sqrt(1 - 0.93**2) * x[:, 1]  # of the inner product with a vector at that cosine
    assert np.isclose((near > 0.3)[x[:, 0] > 0.3].mean(), caps._both(0.3, 0.93, 64), rtol=0.05)


def test_caps_labels_have_codes_of_their_size(spark, monkeypatch):
    asked, make = [], caps.codes_for
    monkeypatch.setattr(caps, "codes_for", lambda dim, count, *rest: asked.append(count) or make(dim, count, *rest))
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), int(i >= 600)) for i in range(620)]
    rows += [(1000 + i, (np.array(rows[i][1]) * 2).tolist(), rows[i][2]) for i in (5, 610)]
    got = {r["vec_id"]: r["component_id"] for r in caps.near_duplicates(vectors(spark, rows)).collect()}
    assert sorted(asked) == [256, 1024] and got[1005] == got[5] and got[1610] == got[610]


def test_caps_awkward(spark):
    assert caps.near_duplicates(vectors(spark, [])).count() == 0
    bare = vectors(spark, [(1, None, 1), (None, [1.0], 1), (2, [1.0, 0.0], None)])
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in caps.near_duplicates(bare).collect()) == [(0, 0, True), (1, 0, True), (2, 0, True)]
    twice = vectors(spark, [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [1.0, 0.1], 1)])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in caps.near_duplicates(twice).collect()) == [(7, 2, 7), (7, 2, 7), (8, 2, 7)]


# --- top-k search ---------------------------------------------------------------


def brute_top(rows, queries, k=5):
    fine = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v, _ in rows
            if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in sorted(set(queries)):
        if q in fine:
            hits = sorted((-int(fine[q] @ x), i) for i, x in fine.items() if i != q and len(x) == len(fine[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [8 << 20, 3000])
def test_top_k_against_brute_force(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(block_topk, "QUERY_BYTES", query_bytes)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).astype(np.float32).round(1).tolist(), 0) for i in range(1200)]
    rows += [(1200 + i, rows[50][1], 0) for i in range(300)]  # many ties
    rows += [(2000, None, 0), (2050, [float("inf")] * 16, 0), (2100, [None] * 16, 0), (None, rows[0][1], 0), (2150, [1.0, 2.0], 0), (2200, [], 0)]
    table = vectors(spark, rows)
    got = block_topk.top_k(table, table.filter("vec_id % 50 = 0"))
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute_top(rows, [r[0] for r in rows if r[0] is not None and r[0] % 50 == 0])


def test_top_k_awkward(spark):
    table = vectors(spark, [])
    assert block_topk.top_k(table, table).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0)])
    assert sorted(map(tuple, block_topk.top_k(few, few.filter("vec_id = 0")).collect())) == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256)]
    with pytest.raises(ValueError):
        huge = vectors(spark, [(0, [1e30, 0.0], 0)])
        block_topk.top_k(huge, huge).count()


def test_bounds_are_never_too_small():
    rng = np.random.default_rng(3)
    x, q = np.floor(rng.normal(size=(64, 8)) * 50), np.floor(rng.normal(size=(9, 8)) * 50)
    bound = block_topk._bounds(q, x.max(0)[None], x.min(0)[None])[:, 0]
    assert (bound >= (q @ x.T).max(1)).all()


# --- pipeline -------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    table = awkward(spark)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == table.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter("NOT exact").isEmpty() and out.count() == rows.count() > 0


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(2)
    texts = [words(40, 10 + i) for i in range(40)]
    rows = [(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " more", "en", "a", 0) for i in range(10)]
    rows += [(200, "1234 !!", "en", "a", 0), (201, words(30, 77) + " mail zed.11@mail1.example.com", "en", "b", 0)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, table, "")
    assert {r["doc_id"] for r in known.collect()} == {r[0] for r in rows} - {200}
    single = stages["near_duplicates"](spark, known, "")
    assert {r["doc_id"] for r in single.collect()} == set(range(40)) | {201}
    clean = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, single, "").collect()}
    assert "zed.11" not in clean[201] and clean[0] == texts[0]
    mixed = stages["mixture"](spark, single, "")
    assert mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).count() == 2


def test_pipeline_empty(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_caps_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(21)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: (v + 0.01 * rng.normal(size=16)).tolist()
    rows = [(1, a.tolist(), "x"), (1, b.tolist(), "x"), (2, near(a), "x"), (3, near(b), "x"), (3, near(b), "y"), (4, near(b), "y")]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in caps.near_duplicates(given.repartition(3)).collect())
    # Each row of id 1 has one link; the rows of label y link with one another only.
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
