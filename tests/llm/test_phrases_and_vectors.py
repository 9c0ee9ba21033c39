"""Byte-pair coding, whitening and collocations on small tables."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import phrases, rank_bpe, whitening
from tests.llm.cases import awkward, docs, empty, words

BPE = public_tokenizers.path("word_bpe_49k.json")


# --- byte-pair coding ---------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def agrees(bpe, library, texts):
    counts, ids = bpe.encode_texts(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, text[:100]
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False), text[:100]


def test_rank_bpe_equals_library(library):
    bpe = rank_bpe.RankBpe(BPE)
    agrees(bpe, library, [
        "", "  \n", "<|ENDOFTEXT|>", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "it's It'LL we'Ve 'S", "İx ǅ ΑΣ ΣΑΣ",
        "\x1c a\x85b c　d", "日本語ab ½ ① ²x3", "é ́b <|endoftext|>́", "x" * 5000, "abc" * 3000, "\x00 \x1f",
    ])
    rng = random.Random(3)
    letters = [*"abcdeABCé'’ \t\n.,!<|>09ÀßΣσ日́\U0001f600İ\x85", "<|endoftext|>", "<|ENDOFTEXT|>", " 'll"]
    agrees(bpe, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)])


def test_scans_and_heap_agree():
    bpe, rng = rank_bpe.RankBpe(BPE), random.Random(5)
    given = ["".join(rng.choice("aehilnorstu") for _ in range(rng.randint(1, rank_bpe.SHORT))).encode() for _ in range(2000)]
    counts, ids = bpe.encode_words(given)
    ends = np.cumsum(counts)
    for word, a, b in zip(given, ends - counts, ends):
        assert bpe.merge_long(bpe._parts(word).tolist()) == ids[a:b].tolist()


def test_rank_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        rank_bpe.RankBpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_rank_bpe_awkward(spark, library):
    given = awkward(spark)
    out = rank_bpe.encode_documents(given, BPE)
    assert out.columns == ["doc_id", "ids", "decoded"]
    texts = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids))
                    for r in given.select("doc_id", "text").collect())
    rows = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == texts
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert rank_bpe.encode_documents(empty(spark), BPE).collect() == []


# --- whitening ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label string, x string, dim int, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1, "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("dim,rank", [(1, 1), (5, 5), (8, 3), (40, 40), (41, 7), (6, 0)])
def test_factor_and_rotations_equal_eigenvalues(dim, rank):
    rng = np.random.default_rng(dim)
    root = rng.normal(size=(dim, rank)) * np.logspace(0, -4, rank) if rank else np.zeros((dim, 0))
    matrix = root @ root.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, matrix, atol=1e-13 * max(1, matrix.max(initial=0)))
    values, columns = whitening.jacobi_columns(factor)
    assert np.allclose(columns.T @ columns, np.eye(rank), atol=1e-12)
    assert np.allclose(matrix @ columns, columns * values, atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], atol=1e-12)


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(400, 12)) * np.linspace(2, 0.1, 12)).astype(np.float32)
    out = whitening.whiten(vectors(spark, [(k, v.tolist()) for k, v in enumerate(data)]).repartition(5)).toPandas()
    x = np.floor(1024 * data.astype(float)).astype(np.int64) + 100_000
    y = len(x) * x - x.sum(0)
    variance = (y / len(x)).T @ (y / len(x)) / len(x)
    values, columns = np.linalg.eigh(variance)
    values, columns = values[::-1][:8], columns[:, ::-1][:, :8]
    out = out.sort_values(["vec_id", "component"])
    white = out["whitened"].to_numpy().reshape(-1, 8)
    assert np.allclose(np.abs(white), np.abs(y / len(x) @ columns / np.sqrt(values)), atol=1e-9)
    assert np.allclose(white.T @ white / len(x), np.eye(8), atol=1e-9) and out["identity_error"].max() < 1e-9
    assert out["identity_error"].nunique() == 1 and (out["n"] == 400).all()
    assert [int(d) for d in out["deviation"][:: 8]] == (y * y).sum(1).tolist()
    assert np.allclose(out["explained"][:8], values / np.trace(variance), rtol=1e-9)


def test_whiten_awkward(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, None), (4, [1.0, None]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [2.0, 2.0, 1.0])]
    out = whitening.whiten(vectors(spark, rows)).collect()
    found = Counter((r["vec_id"], r["n"]) for r in out)
    # Two components of the four vectors of length 2; two vectors of length 3 span one.
    assert found == {(1, 4): 4, (2, 4): 2, (None, 4): 2, (8, 2): 1, (9, 2): 1}
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_deviation_beyond_63_bits(spark):
    rows = [(1, [2.0**22, 0.0])] * 3 + [(2, [-(2.0**22), 0.0])]
    out = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, rows)).collect()}
    x = [2**32 + 100_000] * 3 + [-(2**32) + 100_000]
    assert int(out[2]["deviation"]) == (4 * x[3] - sum(x)) ** 2 > 2**63


# --- collocations -------------------------------------------------------------

def brute(rows, longest=3, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in frequent.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(k == lang and len(q) > len(p) and 100 * f >= 50 * a and inside(q) for (k, q), f in frequent.items()):
            continue
        score, k = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -score)
                  for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def result(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_collocations_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["New", "york", "big", "Apfel", "über", "it", "of", "the", "日本", "x y", "a"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, ""]), text()) for _ in range(500)]
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    want = brute(rows)
    assert len({r[0] for r in want}) == 4 and result(df.repartition(7)) == want
    assert result(df, top=3, longest=4, least=5) == brute(rows, longest=4, least=5, top=3)
    assert result(df, longest=2, least=1) == brute(rows, longest=2, least=1)


def test_collocations_awkward(spark):
    given = awkward(spark)
    rows = [(r["lang"], r["text"]) for r in given.collect()]
    assert result(given, least=2) == brute(rows, least=2)
    assert result(empty(spark)) == []
    assert result(docs(spark, [None, "", " \n"])) == []
    hot = docs(spark, ["same line here"] * 500 + [words(5, k) for k in range(20)])
    assert result(hot) == brute([("en", r["text"]) for r in hot.collect()])


def test_long_texts_are_cut_at_piece_ends(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1 << 10)
    text = ". ".join("one two three four five" for _ in range(2000))
    batch = pa.RecordBatch.from_pydict({"text": ["", text, "x " * 3000, None, text], "lang": ["a", "b", "a", "a", "b"]})
    parts = list(phrases.portions_of([batch]))
    assert len(parts) > 50 and "".join(s for t, _ in parts for s in t.to_pylist()) == text + "x " * 3000 + text
    counts = Counter()
    for texts, langs in parts:
        found = phrases.Words(texts, langs)
        one, n = found.counted(2, found.grams(2))
        counts.update(dict(zip(found.phrases(2, one).to_pylist(), n.tolist())))
    assert counts == {"one two": 4000, "two three": 4000, "three four": 4000, "four five": 4000, "x x": 2999}


@pytest.mark.parametrize("seed", range(5))
def test_summary_keeps_every_frequent_key(seed):
    rng, least = np.random.default_rng(seed), 10
    keys = np.minimum(rng.zipf(1.3, 60_000), 50_000).astype(np.uint32)
    true = Counter(keys.tolist())
    summary = phrases.Summary(len(keys) // least + 1)
    for part in np.array_split(keys, 23):
        summary.add(*phrases._merged(part, np.ones(len(part), dtype=np.int64)))
        summary.settle()
        assert len(summary.keys) <= summary.capacity
    kept = set(summary.survivors(least).tolist())
    assert summary.taken < least and {k for k, f in true.items() if f >= least} <= kept
    small = phrases.Summary(50)
    small.add(*phrases._merged(keys, np.ones(len(keys), dtype=np.int64)))
    assert small.survivors(len(keys) // 50) is not None and small.taken <= len(keys) / 51
