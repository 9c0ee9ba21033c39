"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 3- and 4-grams inside the lower-case words of a text, edges
included, hashed into buckets. Training is stochastic gradient descent in numpy on a
bounded sample of labelled documents (at most ``per_language`` of each language); a part
of the sample is kept out to fit the temperature of the scores and the threshold below
which a document is rejected. For prediction the embeddings and the softmax weights are
multiplied once, so a text's scores are the mean of its subwords' rows of one small table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from netloom.llm.common import map_texts, portions, renamed, table, text_bytes

BUCKET_BITS = 16
DIM = 16
# Training documents of each language, the bound of what the driver gathers.
PER_LANGUAGE = 500
# Ranges of the draw, as a power of two.
SPAN_BITS = 12
# Part of the sample that calibrates, and the share of it that may fall below the threshold.
CALIBRATION = 5
REJECTED = 0.002
NO_LANGUAGE = "und"
# Bytes of text whose subwords are in memory at once.
SLICE_BYTES = 1 << 20
_SPACE = 32


def subwords(texts: pa.Array) -> tuple:
    """(bucket of each subword, number of subwords per text) of an Arrow string array."""
    texts = pc.utf8_lower(texts)
    raw = text_bytes(texts)
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    # One space before and one behind each text: no subword reaches into the next text.
    place = np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    padded = np.full(len(raw) + 2 * len(sizes), _SPACE, dtype=np.uint8)
    padded[place] = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, _SPACE)
    ends = np.cumsum(sizes + 2)
    letter = padded != _SPACE
    wide = padded.astype(np.uint32)
    buckets, owners = [], []
    for n, factor in ((3, 2654435761), (4, 2246822519)):
        if len(padded) < n:
            continue
        count = len(padded) - n + 1
        inside = letter[1 : count + 1].copy()
        for k in range(2, n - 1):
            inside &= letter[k : count + k]
        at = np.flatnonzero(inside)
        value = np.zeros(len(at), dtype=np.uint32)
        for k in range(n):
            value = value * np.uint32(16777619) ^ wide[at + k]
        buckets.append((value * np.uint32(factor & 0xFFFFFFFF)) >> np.uint32(32 - BUCKET_BITS))
        owners.append(np.searchsorted(at, ends))
    if not buckets:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(sizes), dtype=np.int64)
    counts = [np.diff(o, prepend=0) for o in owners]
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(sizes)), c) for c in counts]), kind="stable")
    return np.concatenate(buckets)[order], sum(counts)


@dataclass
class LanguageModel:
    languages: list
    rows: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        buckets, counts = subwords(texts)
        out = np.zeros((len(counts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self.rows[:, k][buckets], starts) / counts[some]
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple:
        """(language, score, rejected) per text."""
        logits = [self.logits(part) for part in portions(texts, SLICE_BYTES)]
        scores = _softmax(np.concatenate(logits) / self.temperature)
        best, score = scores.argmax(1), scores.max(1)
        bare = ~np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
        names = np.array([*self.languages, NO_LANGUAGE], dtype=object)
        best[bare], score[bare] = len(self.languages), 0.0
        return names[best], score, bare | (score < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(documents: list, epochs: int = 6, rate: float = 8.0, batch: int = 32, seed: int = 5) -> LanguageModel:
    """Fit on (language, distinct buckets, their counts, calibrates) per document."""
    languages = sorted({d[0] for d in documents})
    target = np.array([languages.index(d[0]) for d in documents])
    ids = [np.asarray(d[1], dtype=np.int64) for d in documents]
    share = [np.asarray(d[2], dtype=np.float64) / max(1, sum(d[2])) for d in documents]
    fitted = np.flatnonzero([not d[3] for d in documents])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIM, (1 << BUCKET_BITS, DIM))
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, step = epochs * max(1, -(-len(fitted) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for a in range(0, len(order), batch):
            members = order[a : a + batch]
            flat = np.concatenate([ids[m] for m in members])
            part = np.concatenate([share[m] for m in members])
            owner = np.repeat(np.arange(len(members)), [len(ids[m]) for m in members])
            mean = np.zeros((len(members), DIM))
            np.add.at(mean, owner, embed[flat] * part[:, None])
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(members)), target[members]] -= 1
            error /= len(members)
            now = rate * (1 - step / steps)
            back = error @ weights.T
            weights -= now * (mean.T @ error)
            bias -= now * 0.1 * error.sum(0)
            # A subword's share of a text is small; its step is scaled by the number of subwords.
            width = np.array([len(ids[m]) for m in members], dtype=np.float64)
            np.add.at(embed, flat, -now * 0.05 * (part * width[owner])[:, None] * back[owner])
            step += 1
    rows = embed @ weights
    logits = np.array([(rows[i] * s[:, None]).sum(0) for i, s in zip(ids, share)]).reshape(-1, len(languages)) + bias
    held = np.flatnonzero([d[3] for d in documents])
    held = held if len(held) else fitted
    temperature = _temperature(logits[held], target[held])
    score = _softmax(logits[held] / temperature).max(1)
    threshold = min(0.5, 0.9 * float(np.quantile(score, REJECTED)))
    return LanguageModel(languages, rows, bias, temperature, threshold)


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The one of a grid of temperatures that gives the true languages most likelihood."""
    grid = np.geomspace(0.5, 20, 40)
    right = np.arange(len(target))
    loss = [-np.log(_softmax(logits / t)[right, target] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _features():
    def of(texts):
        ids, numbers = [], []
        for some in portions(texts, SLICE_BYTES):
            buckets, counts = subwords(some)
            for part in np.split(buckets, np.cumsum(counts)[:-1]):
                distinct, count = np.unique(part, return_counts=True)
                ids.append(distinct.astype(np.int32))
                numbers.append(count.astype(np.int32))
        return pa.array(ids, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))

    return of


def id_digest(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def held_out(id_col: str = "doc_id"):
    return id_digest(id_col) % 5 == 0


def _lowest(slim: DataFrame, least: int) -> DataFrame:
    """Rows of ``slim`` (id, lang, draw) in the lowest ranges of the draw that hold ``least`` rows of their language.

    So few rows of a language, however frequent, are left to be ranked. The lookup has one row per
    language, of which the model holds a column each.
    """
    span = F.shiftright("draw", 64 - SPAN_BITS)
    upto = Window.partitionBy("lang").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)  # 2^SPAN_BITS rows at most
    ends = slim.groupBy("lang", span.alias("span")).count().withColumn("upto", F.sum("count").over(upto))
    cut = ends.groupBy("lang").agg(F.min(F.when(F.col("upto") >= least, F.col("span"))).alias("cut"))
    kept = slim.join(F.broadcast(cut), "lang").filter(F.col("cut").isNull() | (span <= F.col("cut")))
    return kept.select("id", "lang", "draw")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, seed: int = 5) -> LanguageModel | None:
    """Train on at most ``per_language`` documents per language, chosen by a hash of their ids.

    Documents whose crc32(id) is divisible by 5, without language or without subwords are
    not learned from; of rows with the same id one counts. None when nothing is left.
    """
    draw = F.xxhash64(F.lit(seed), F.col(id_col))
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    first = Window.partitionBy("lang").orderBy("draw", "id")
    slim = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    picked = _lowest(slim, per_language).withColumn("n", F.row_number().over(first))
    picked = picked.filter(F.col("n") <= per_language).select("id").distinct()
    texts = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(picked), "id", "left_semi")  # at most per_language ids per language
    texts = texts.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("one")).select("id", "one.*")
    rows = map_texts(texts, "text", "buckets array<int>, counts array<int>", _features, keep=["id", "lang"])
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["id"], r["buckets"]))  # bounded, see per_language
    sample = [(r["lang"], r["buckets"], r["counts"], k % CALIBRATION == 0) for k, r in enumerate(found) if r["buckets"]]
    return train(sample, seed=seed) if sample else None


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    Null texts and texts without a letter get ``und``, score 0 and are rejected. Without
    a model every text does. The whole text counts, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 rows, one column per language

    def make():
        def of(texts):
            if shared.value is None or not len(texts):
                n = len(texts)
                return pa.array([NO_LANGUAGE] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, dtype=bool))
            lang, score, rejected = shared.value.predict(texts)
            return pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)

        return of

    return map_texts(docs, text_col, "lang_pred string, score double, rejected boolean", make)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language a model fitted on them rejects.

    Where there is nothing to learn from, only texts without a letter go.
    """
    model = fit(docs, id_col, text_col, lang_col)
    inner, back = renamed(docs)
    text = f"c{docs.columns.index(text_col)}"
    if model is None:
        return back(inner.filter(F.col(text).rlike(r"\p{L}")))
    return back(predict(inner, model, text).filter(~F.col("rejected")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
