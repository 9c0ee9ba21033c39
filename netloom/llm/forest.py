"""Near-duplicate documents: an LSH forest over MinHash signatures, then exact Jaccard.

Each tree of the forest is the trie of a few MinHash values; two texts meet in a tree when
they share a prefix of the depth that is in use there. Depths start at the longest prefix
and are shortened, tree by tree, until a pair right at the threshold meets with the target
recall. Rows with equal prefixes are brought together by sorting, which visits the tries'
nodes in order. Pairs whose short sketches agree too little are passed over, the rest form
loose groups, and inside those the similarity of all pairs is computed exactly from the
shingle sets. Texts with the same words are one class from the start. Groups of any size
are cut into blocks; no pair of a group is written out.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import map_texts, portions, table, text_bytes, with_unique_id
from netloom.llm.graph import components, grouped, in_blocks, small, star_edges, stars, whole_groups
from netloom.plans.sizing import durable

WORDS = 5
SIMILARITY = 0.8
TREES = 24
DEEPEST = 6
RECALL = 0.9999
SKETCH = 64
# Signatures of texts at SIMILARITY agree in this share of the sketch but for one pair in 10^8.
SKETCH_LEAST = 0.5
BLOCK_ROWS = 4096
# Shingles and rows of a loose group in one block; a task compares two blocks with one another.
BLOCK_SHINGLES = 300_000
VERIFY_ROWS = 1024
# A column of a group's shingle table with more rows goes into a matrix product.
RARE = 32
# Edges of a large node that are held before they are reduced to stars.
_EDGES = 1 << 20
_SLICE_BYTES = 1 << 20
_ODD = r"[^\x00-\x7F\p{L}\p{N}\p{M}]"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BASE = 0x100000001B3
_powers: dict = {}


def depths(trees: int = TREES, deepest: int = DEEPEST, similarity: float = SIMILARITY, recall: float = RECALL) -> list:
    """Prefix length per tree: shortened one tree at a time, longest first, until the recall is reached."""
    use = [deepest] * trees
    while math.prod(1 - similarity**d for d in use) > 1 - recall and max(use) > 1:
        use[use.index(max(use))] -= 1
    return use


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array) -> tuple:
    """(hash of each word, words per text). Words are runs of letters, marks and digits in lower case."""
    texts = pc.utf8_lower(texts)
    odd = pc.match_substring_regex(texts, _ODD)
    if pc.any(odd).as_py():
        texts = pc.if_else(odd, pc.replace_substring_regex(texts, _ODD, " "), texts)
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    raw = text_bytes(texts)
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    edge = np.zeros(len(raw) + 1, dtype=bool)
    ends = np.cumsum(sizes)
    edge[ends] = True  # a word ends with its text
    before = np.concatenate([[False], inside[:-1]]) & ~edge[: len(raw)] if len(raw) else inside
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(raw) else inside
    stops = np.flatnonzero(inside & ~after) + 1
    up, down = _power_table(len(raw) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    hashes = _mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _MIX[0])
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    return hashes, np.diff(first)


def shingles(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple:
    """(hash of each run of ``words`` words, runs per text); a shorter text that has words is one run."""
    runs = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    left = np.repeat(counts, runs)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        word = padded[at + k]
        value = (value ^ np.where(left > k, word, np.uint64(0))) * _MIX[k % len(_MIX)]
        value ^= value >> np.uint64(29)
    return _mixed(value), runs


def _permutations(count: int, seed: int = 3) -> tuple:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def signatures(values: np.ndarray, runs: np.ndarray, count: int) -> np.ndarray:
    """Text x hash function: the smallest value of each function over a text's shingles."""
    out = np.zeros((len(runs), count), dtype=np.uint32)
    some = np.flatnonzero(runs)
    if len(some):
        factor, shift = _permutations(count)
        starts = (np.cumsum(runs) - runs)[some]
        low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        for k in range(count):
            out[some, k] = np.minimum.reduceat((low ^ shift[k]) * factor[k] + high, starts)
    return out


def _digests(words: int, use: list):
    functions = sum(use) if sum(use) >= SKETCH else SKETCH

    def make():
        def of(texts):
            keys, sketches, classes = [], [], []
            for part in portions(texts, _SLICE_BYTES):
                hashes, counts = word_hashes(part)
                values, runs = shingles(hashes, counts, words)
                mins = signatures(values, runs, functions)
                ends = np.cumsum(counts)
                for a, b in zip(ends - counts, ends):
                    classes.append(hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else None)
                at, row = 0, []
                for tree, depth in enumerate(use):
                    key = np.full(len(mins), tree + 1, dtype=np.uint64)
                    for k in range(at, at + depth):
                        key = _mixed((key + mins[:, k]) * _MIX[0])
                    row.append(key.view(np.int64))
                    at += depth
                keys.append(np.stack(row, 1))
                sketches += [r.tobytes() for r in (mins[:, :SKETCH] & np.uint32(255)).astype(np.uint8)]
            flat = np.concatenate(keys) if keys else np.zeros((0, len(use)), dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(use), dtype=np.int32)), pa.array(flat.ravel()))
            return pa.array(classes, pa.binary()), lists, pa.array(sketches, pa.binary())

        return of

    return make


def _sets(words: int):
    def make():
        def of(texts):
            rows = []
            for part in portions(texts, _SLICE_BYTES):
                values, runs = shingles(*word_hashes(part), words)
                rows += [np.unique(v).view(np.int64) for v in np.split(values, np.cumsum(runs)[:-1])]
            lengths = np.array([len(r) for r in rows], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            return (pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),)

        return of

    return make


def _alike(batches):
    """Edges that connect rows of a trie node whose sketches agree: one per row and table at most."""
    for t, starts in whole_groups(batches, "key"):
        reps = t["rep"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = np.flatnonzero((sizes <= RARE)[group])
        found = []
        for d in range(1, min(RARE, int(sizes.max(initial=0)))):
            i, j = few[:-d], few[d:]
            near = group[i] == group[j]
            i, j = i[near], j[near]
            near = (sketch[i] == sketch[j]).sum(1) >= SKETCH_LEAST * SKETCH
            found.append(np.stack([reps[i[near]], reps[j[near]]]))
        for a, b, n in zip(starts, starts[1:], sizes):
            if n > RARE:
                found.append(reps[a:b][_led(sketch[a:b])])
        if found:
            pairs = star_edges(*np.concatenate(found, 1))
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["a", "b"])


def _led(sketch: np.ndarray) -> np.ndarray:
    """Edges that connect all alike rows of a large node, without comparing all pairs.

    A row that no leader covers becomes a leader and is compared with all rows. Rows at
    similarity 0.8 or more to a leader are covered. Two rows with similarity of 0.8 of
    which one is covered lie within 0.4 of a leader (one minus Jaccard is a distance), so
    edges from a leader reach down to 0.45, below that by more than the sketch's error.
    """
    covered = np.zeros(len(sketch), dtype=bool)
    edges, held = [], 0
    for row in range(len(sketch)):
        if not covered[row]:
            agree = (sketch == sketch[row]).mean(1)
            covered |= agree >= 0.85
            near = np.flatnonzero(agree >= 0.45)
            edges.append(np.stack([np.full(len(near), row), near]))
            held += len(near)
            if held > _EDGES:  # rows that are alike, yet cover one another nowhere, have all pairs as edges
                edges = [np.stack(star_edges(*np.concatenate(edges, 1)))]
                held = edges[0].shape[1]
    return np.concatenate(edges, 1)


def _verified(similarity: float):
    """Exact links of whole loose groups: (rep, linked documents) and star edges of the links."""

    def run(batches):
        weight = lambda t: pc.list_value_length(t["set"]).to_numpy()
        for t, starts in whole_groups(batches, "comp", weight, BLOCK_SHINGLES):
            reps, copies, side = (t[c].to_numpy() for c in ("rep", "copies", "side"))
            cross = t["bi"].to_numpy() != t["bj"].to_numpy()
            sets = t["set"].combine_chunks() if isinstance(t["set"], pa.ChunkedArray) else t["set"]
            sizes = np.asarray(pc.list_value_length(sets), dtype=np.int64)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            row = np.repeat(np.arange(len(sizes)), sizes)
            value = np.asarray(sets.flatten())
            order = np.lexsort((row, value, group[row]))
            row, value = row[order], value[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (value[1:] != value[:-1]) | (group[row[1:]] != group[row[:-1]])
            column = np.cumsum(new) - 1
            df = np.bincount(column) if len(column) else np.zeros(0, dtype=np.int64)
            links, edges = np.zeros(len(sizes), dtype=np.int64), []
            rare = np.flatnonzero(df[column] <= RARE) if len(column) else np.zeros(0, dtype=np.int64)
            codes = []
            for d in range(1, RARE):
                i, j = rare[:-d], rare[d:]
                same = column[i] == column[j]
                if not same.any():
                    break
                codes.append(row[i[same]] * len(sizes) + row[j[same]])
            code, shared = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            left, right = code // max(1, len(sizes)), code % max(1, len(sizes))
            hot = np.unique(group[row[df[column] > RARE]]) if len(column) else []
            wide = np.zeros(len(starts) - 1, dtype=bool)
            wide[hot] = True
            plain = ~wide[group[left]] if len(left) else np.zeros(0, dtype=bool)
            l, r, n = left[plain], right[plain], shared[plain]
            ok = (n >= similarity * (sizes[l] + sizes[r] - n) - 1e-9) & (~cross[l] | (side[l] != side[r]))
            np.add.at(links, l[ok], copies[r[ok]])
            np.add.at(links, r[ok], copies[l[ok]])
            edges.append(np.stack([reps[l[ok]], reps[r[ok]]]))
            for g in hot:
                a, b = starts[g], starts[g + 1]
                common = np.zeros((b - a, b - a), dtype=np.float32)
                mine = group[left] == g
                np.add.at(common, (left[mine] - a, right[mine] - a), shared[mine])
                common += common.T
                own = (row >= a) & (row < b) & (df[column] > RARE)
                columns, at = np.unique(column[own], return_inverse=True)
                rows = row[own] - a
                for c in range(0, len(columns), 4096):
                    part = (at >= c) & (at < c + 4096)
                    m = np.zeros((b - a, min(4096, len(columns) - c)), dtype=np.float32)
                    m[rows[part], at[part] - c] = 1
                    common += m @ m.T
                size = sizes[a:b].astype(np.float64)
                linked = np.empty(common.shape, dtype=bool)
                for c in range(0, b - a, 256):  # sums of a few rows at a time
                    some = slice(c, c + 256)
                    linked[some] = common[some] >= similarity * (size[some, None] + size[None, :] - common[some]) - 1e-9
                    if cross[a]:
                        linked[some] &= side[a:b][some, None] != side[a:b][None, :]
                    linked[some, :][np.arange(min(256, b - a - c)), np.arange(c, min(c + 256, b - a))] = False
                    links[a + c : min(a + c + 256, b)] += linked[some] @ copies[a:b]
                top = stars(linked)
                edges.append(np.stack([reps[a:b], reps[a:b][top]]))
            pairs = np.stack(star_edges(*np.concatenate(edges, 1)))
            some = np.flatnonzero(links)
            rep = np.concatenate([reps[some], pairs[0]])
            other = pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), pairs[1]]), mask=np.arange(len(rep)) < len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), other, pa.array(np.concatenate([links[some], np.zeros(pairs.shape[1], dtype=np.int64)]))],
                names=["rep", "other", "links"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Links of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.

    One row per row of ``docs``: the id, ``class_id`` (smallest id with the same words),
    ``n_links`` (other rows linked, copies included), ``component_id`` (smallest id that
    links reach) and ``kept`` (it is its component's smallest). A text of fewer than
    ``words`` words is one shingle. Null texts and texts without a word link with nothing.
    Links between different texts are verified exactly; one is missed with a probability
    of 1 - ``recall`` at most. If ids are null or repeated, rows are numbered and
    ``class_id``, ``component_id`` are such numbers. Other columns are left out.
    """
    base, row_id = with_unique_id(docs, id_col, list(dict.fromkeys([id_col, text_col])), "near")
    own = base.select(F.col(row_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = durable(map_texts(own, "text", "class binary, keys array<long>, sketch binary",
                             _digests(words, depths(similarity=similarity, recall=recall)), keep=["id"]), "signatures")
    worded = rows.filter("class IS NOT NULL")
    kinds = durable(worded.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = rows.join(kinds.select(F.col("rep").alias("id")), "id", "left_semi")
    placed = reps.select(F.col("id").alias("rep"), F.explode("keys").alias("key"))
    nodes = durable(placed.groupBy("key").count().filter("count > 1").select(
        "key", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "nodes")
    dealt = durable(in_blocks(placed, nodes, "key", "rep"), "dealt")
    dealt = dealt.join(reps.select(F.col("id").alias("rep"), "sketch"), "rep")
    loose = grouped(dealt, "key", "rep").select("key", "bi", "bj", "rep", "sketch").mapInArrow(_alike, "a long, b long")
    groups = durable(components(loose).withColumnRenamed("component", "comp"), "loose")
    wanted = groups.join(kinds, F.col("rep") == F.col("node")).select("comp", "rep", "copies")
    texts = own.join(small(groups.select(F.col("node").alias("id"))), "id", "left_semi")
    sets = durable(map_texts(texts, "text", "set array<long>", _sets(words), keep=["id"]), "sets")
    sets = sets.withColumnRenamed("id", "rep").join(wanted, "rep")
    sizes = durable(sets.groupBy("comp").agg(F.sum(F.size("set")).alias("n"), F.count(F.lit(1)).alias("rows")).select(
        "comp", F.greatest(F.ceil(F.col("n") / BLOCK_SHINGLES), F.ceil(F.col("rows") / VERIFY_ROWS)).alias("blocks")), "loose-sizes")
    dealt = grouped(in_blocks(sets, sizes, "comp", "rep"), "comp", "rep")
    found = durable(dealt.select("comp", "bi", "bj", "side", "rep", "copies", "set").mapInArrow(
        _verified(similarity), "rep long, other long, links long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other IS NOT NULL"), "rep", "other")
    classes = kinds.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    classes = classes.select("class", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"),
                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "class").join(classes, "class", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    if row_id == id_col:
        return out.withColumnRenamed("id", id_col)
    ids = base.select(F.col(row_id).alias("id"), F.col(id_col).alias("__given"))
    return out.join(ids, "id").drop("id").withColumnRenamed("__given", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents, that of the smallest id."""
    columns = docs.columns
    base, row_id = with_unique_id(docs, id_col, columns, "near")
    found = near_duplicates(base, row_id, text_col)
    gone = durable(found.filter(~F.col("kept")).select(F.col(row_id).alias("__gone")), "gone")
    return base.join(small(gone), F.col(row_id) == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
