"""Collocations: frequent phrases scored by how far they outnumber their parts.

Every n-gram has a hash; its leading bits name a hash partition, the next 32 bits stand for
it there. A first pass counts hashes per task and merges the counts of each partition into
a Misra-Gries summary whose capacity exceeds the partition's mass (its n-gram occurrences)
divided by the threshold. What the summary took off a counter is less than the threshold,
so every frequent n-gram keeps a counter; those that could not reach the threshold even
with all that was taken off are left. The survivors become bits of a filter of fixed size.
A second pass counts the n-grams that pass the filter exactly, by their words.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import plain_strings, release, slices, table, text_bytes
from netloom.plans.sizing import durable

LONGEST = 3
LEAST = 10
TOP = 2000
COVERED = 50  # per cent of a phrase's count at which a longer phrase covers it
FACTOR = 1_000_000
SLICE_BYTES = 2 << 20
# Bytes of text per hash partition, and the fewest and most partitions (powers of two).
PARTITION_BYTES = 8 << 20
PARTITIONS = (64, 1 << 22)
# The filter that is sent to all tasks has 2 ** FILTER_BITS bits (16 MB), whatever the data.
FILTER_BITS = 27
# Distinct n-grams a task holds before it hands its counts on.
HELD = 1 << 20
# It hands them on before a count could pass 32 bits, too.
MOST_SEEN = 1 << 31
_BREAK, _BLANK, _WORD = 0, 1, 2
# Groups of phrases of a language that are ranked apart before they are ranked together.
RANKED_APART = 64
COUNTS = "part int, lang string, mass long, keys binary, counts binary"


def _byte_classes() -> tuple:
    kind, lower = np.full(256, _WORD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
    kind[list(b" \t")] = _BLANK
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _byte_classes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values (a finaliser of public hash functions)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, the same on every machine."""
    raw = text_bytes(values).astype(np.uint64)
    lengths = np.asarray(pc.binary_length(values), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed((place << np.uint64(8)) + raw + np.uint64(1)))])
    return _mixed(sums[starts + lengths] - sums[starts] + lengths.astype(np.uint64))


def cut_long(texts: pa.Array, langs: pa.Array, limit: int) -> tuple:
    """(texts, langs) where texts over ``limit`` bytes are cut behind piece ends, which leaves their pieces whole."""
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    if not (sizes > limit).any():
        return texts, langs
    raw, ends = text_bytes(texts), np.cumsum(sizes)
    edges, owner = [0], []
    for k, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        if size > limit:
            stops = np.flatnonzero(_KIND[raw[end - size : end]] == _BREAK) + 1
            stops = stops[np.flatnonzero(np.diff(stops // limit, prepend=0))]
            stops = stops[stops < size]
            edges += (end - size + stops).tolist()
            owner += [k] * len(stops)
        edges.append(end)
        owner.append(k)
    parts = pa.StringArray.from_buffers(len(owner), pa.py_buffer(np.array(edges, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    return parts, langs.take(pa.array(owner))


def portions_of(batches):
    """(texts, langs) of Arrow batches, some megabytes at a time."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            texts, langs = cut_long(plain_strings(batch["text"]), batch["lang"], SLICE_BYTES)
            ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
            cut = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
            edges = [0, *cut.tolist(), len(texts)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield texts.slice(a, b - a), langs.slice(a, b - a)
        release()


class Words:
    """The words of a slice of texts: a code per word, its strings, and where pieces end.

    A code stands for a word in a language, so equal runs of codes are equal phrases of a language.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw = _LOWER[text_bytes(texts)]
        kind = _KIND[raw]
        ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        inside = kind == _WORD
        edge = np.zeros(len(raw), dtype=bool)  # a text's first byte
        edge[ends[:-1][ends[:-1] < len(raw)]] = True
        begins = inside & (~np.concatenate([[False], inside[:-1]]) | edge)
        starts = np.flatnonzero(begins)
        order = np.cumsum(inside)
        text = np.searchsorted(ends, starts, side="right")
        broken = np.cumsum((kind == _BREAK) | edge)[starts]  # grows between words of different pieces
        self.joined = np.concatenate([broken[1:] == broken[:-1], [False]]) if len(starts) else np.zeros(0, dtype=bool)
        offsets = np.append(order[starts] - 1, order[-1] if len(order) else 0).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
        coded, spoken = words.dictionary_encode(), langs.dictionary_encode()
        self.langs = spoken.dictionary
        lang = np.asarray(spoken.indices)[text].astype(np.int64)
        both = lang * max(1, len(coded.dictionary)) + np.asarray(coded.indices)
        distinct, self.codes = np.unique(both, return_inverse=True)
        self.lang_of = distinct // max(1, len(coded.dictionary))
        at = distinct % max(1, len(coded.dictionary))
        self.strings = coded.dictionary.take(pa.array(at))
        self.hashes = _mixed(_string_hashes(coded.dictionary)[at] * np.uint64(3) + _string_hashes(self.langs)[self.lang_of])

    def grams(self, size: int) -> np.ndarray:
        """First words of all contiguous runs of ``size`` words inside pieces."""
        fine = np.ones(max(0, len(self.codes) - size + 1), dtype=bool)
        for k in range(size - 1):
            fine &= self.joined[k : k + len(fine)]
        return np.flatnonzero(fine)

    def gram_hashes(self, size: int, first: np.ndarray) -> np.ndarray:
        h = self.hashes[self.codes[first]]
        for k in range(1, size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.codes[first + k]])
        return h

    def counted(self, size: int, first: np.ndarray) -> tuple:
        """(first word of one occurrence, occurrences) of the different runs that begin at ``first``."""
        key = self.codes[first]
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1] if k > 1 else key
            key = key * len(self.hashes) + self.codes[first + k]
        _, one, counts = np.unique(key, return_index=True, return_counts=True)
        return first[one], counts

    def phrases(self, size: int, first: np.ndarray) -> pa.Array:
        parts = [self.strings.take(pa.array(self.codes[first + k])) for k in range(size)]
        return pc.binary_join_element_wise(*parts, " ")


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Sorted different keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def _merged_runs(given: list) -> tuple:
    """The same for sorted runs of (64-bit keys, counts), a sixteenth of the key range at a time."""
    out = []
    bounds = [np.searchsorted(k, np.arange(1, 16, dtype=np.uint64) << np.uint64(60)) for k, _ in given]
    edges = [[0, *b.tolist(), len(k)] for b, (k, _) in zip(bounds, given)]
    for r in range(16):
        out.append(_merged(*(np.concatenate(x) for x in zip(*[(k[e[r] : e[r + 1]], c[e[r] : e[r + 1]]) for e, (k, c) in zip(edges, given)]))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, which compress well if most are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, each short of the truth by at most ``taken``."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self.waiting: list = []

    def add(self, keys: np.ndarray, counts: np.ndarray):
        """Another summary's counters, or plain counts. Small ones wait until merging pays."""
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > max(1 << 16, self.capacity):
            self.settle()

    def settle(self):
        given = [(self.keys, self.counts), *self.waiting]
        self.waiting = []
        self.keys, self.counts = _merged(*(np.concatenate(x) for x in zip(*given)))
        if len(self.keys) > self.capacity:
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            self.taken += int(off)
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may occur ``least`` times; all that do are among them if the capacity suffices."""
        self.settle()
        return self.keys[self.counts + self.taken >= least]


def _count(bits: int, longest: int):
    """Per task: the words of each language, and counts of n-gram hashes of each hash partition."""
    shift = np.uint64(64 - bits)

    def blobs(keys, counts):
        if not len(keys):
            return
        part = (keys >> shift).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        short = (keys >> (np.uint64(32) - np.uint64(bits))).astype(np.uint32)
        for a in range(0, len(edges) - 1, 256):
            rows = list(zip(edges[a : a + 256], edges[a + 1 : a + 257]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[i]) for i, _ in rows], pa.int32()), pa.nulls(len(rows), pa.string()),
                 pa.array([int(counts[i:j].sum()) for i, j in rows], pa.int64()),
                 pa.array([_packed(np.diff(short[i:j], prepend=np.uint32(0))) for i, j in rows], pa.binary()),
                 pa.array([_packed(counts[i:j]) for i, j in rows], pa.binary())],
                names=["part", "lang", "mass", "keys", "counts"])

    def run(batches):
        totals: dict = {}
        held = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        fresh, new, seen = [], 0, 0
        for texts, langs in portions_of(batches):
            words = Words(texts, langs)
            spoken = np.bincount(words.lang_of[words.codes], minlength=len(words.langs))
            for lang, n in zip(words.langs.to_pylist(), spoken.tolist()):
                totals[lang] = totals.get(lang, 0) + n
            for size in range(1, longest + 1):
                h = np.sort(words.gram_hashes(size, words.grams(size)))
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
                fresh.append((h[starts], np.diff(np.append(starts, len(h)))))
                new += len(starts)
                seen += len(h)
            if new > HELD // 2 or seen >= MOST_SEEN:
                held, fresh, new = _merged_runs([held, *fresh]), [], 0
                if len(held[0]) > HELD or seen >= MOST_SEEN:
                    yield from blobs(*held)
                    held, seen = (held[0][:0], held[1][:0]), 0
        yield from blobs(*_merged_runs([held, *fresh]))
        totals = {k: n for k, n in totals.items() if n}
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(totals), pa.int32()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()),
             pa.nulls(len(totals), pa.binary()), pa.nulls(len(totals), pa.binary())],
            names=["part", "lang", "mass", "keys", "counts"])

    return run


def _survive(bits: int, least: int):
    """The filter bits of a hash partition, from the merged summaries of its counts; or the words of a language."""
    mine = FILTER_BITS - bits  # a partition has 2 ** mine bits

    def group(whole: pa.Table) -> pa.Table:
        part, lang, mass = whole["part"][0].as_py(), whole["lang"][0].as_py(), pc.sum(whole["mass"]).as_py()
        slots = None
        if part is not None:
            summary = Summary(mass // least + 1)
            for batch in whole.to_batches():
                for keys, counts in zip(batch["keys"], batch["counts"]):
                    summary.add(np.cumsum(_unpacked(keys.as_py()), dtype=np.uint32), _unpacked(counts.as_py()).astype(np.int64))
            marks = np.zeros(max(8, 1 << mine), dtype=bool)
            marks[summary.survivors(least) >> np.uint32(32 - mine)] = True
            slots = np.packbits(marks).tobytes()
        return pa.table([pa.array([part], pa.int32()), pa.array([lang], pa.string()), pa.array([mass], pa.int64()),
                         pa.array([slots], pa.binary())], names=["part", "lang", "mass", "slots"])

    return group


def _recount(shared, bits: int, longest: int):
    """(lang, phrase, f) of the n-grams that pass the filter, counted by their words per slice."""
    mine = FILTER_BITS - bits

    def run(batches):
        slots = np.frombuffer(shared.value, dtype=np.uint8)
        width = max(8, 1 << mine)
        for texts, langs in portions_of(batches):
            words = Words(texts, langs)
            for size in range(1, longest + 1):
                first = words.grams(size)
                h = words.gram_hashes(size, first)
                short = (h >> (np.uint64(32) - np.uint64(bits))).astype(np.uint32)
                at = (h >> np.uint64(64 - bits)).astype(np.int64) * width + (short >> np.uint32(32 - mine))
                passed = slots[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                one, counts = words.counted(size, first[passed.astype(bool)])
                yield pa.RecordBatch.from_arrays(
                    [words.langs.take(pa.array(words.lang_of[words.codes[one]])), words.phrases(size, one),
                     pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])

    return run


def frequent(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple:
    """(counts, totals) of a table (lang, text) without null languages, both stored.

    counts: lang, phrase, size, f of every n-gram of up to ``longest`` words with f >= ``least``;
    totals: lang, n of every language that has words.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = PARTITIONS[0].bit_length() - 1
    while 1 << bits < PARTITIONS[1] and size >> bits > PARTITION_BYTES:
        bits += 1
    # A group holds the counts of one hash partition, some PARTITION_BYTES of text in all, or one number per task.
    counted = texts.mapInArrow(_count(bits, longest), COUNTS).groupBy("part", "lang")
    kept = durable(counted.applyInArrow(_survive(bits, least), "part int, lang string, mass long, slots binary"), "survivors")
    totals = kept.where("part IS NULL").select("lang", F.col("mass").alias("n"))
    width = max(8, 1 << (FILTER_BITS - bits)) // 8
    slots = bytearray(width << bits)
    for row in kept.where("part IS NOT NULL").select("part", "slots").toLocalIterator():  # 2 ** FILTER_BITS bits altogether
        slots[row["part"] * width : (row["part"] + 1) * width] = row["slots"]
    shared = spark.sparkContext.broadcast(bytes(slots))
    grams = texts.mapInArrow(_recount(shared, bits, longest), "lang string, phrase string, f long")
    exact = grams.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return durable(exact.withColumn("size", F.size(F.split("phrase", " "))), "phrases"), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    Returns lang, rank, phrase, a (its occurrences), l and r (those of the two parts of its
    lowest-scoring cut), n (words of the language) and score. Texts are lower-cased in A to Z
    and split at punctuation and line ends; phrases lie inside the pieces. Phrases with fewer
    than ``least`` occurrences are left out, and those covered by a longer one that occurs at
    least half as often. Ties go to the larger a, then to the phrase in byte order. A null text
    is empty, a null language ``und``; ids and other columns do not matter, so repeated rows
    count again. An empty table gives no rows. Whole-number arithmetic is exact up to 10^16
    occurrences.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").alias("text"))
    counts, totals = frequent(texts, longest, least)
    phrases = counts.where("size > 1")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": part(F.lit(1), F.col("k")), "tail": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    exact = lambda c: f"cast({c} AS decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({FACTOR} * ({exact('f')} * {exact('f')})) div ({exact('l')} * {exact('r')})"))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "size", "f").agg(lowest.alias("cut"))
    inner = phrases.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    cover = inner.select("lang", part(F.col("start"), F.col("length")).alias("phrase"), F.col("f").alias("longer"))
    cover = cover.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = scored.join(cover, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < COVERED * F.col("f"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = open_.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score",
                        F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)).alias("share"))
    # The best of every share of a language hold its best, so one task ranks RANKED_APART * top rows at most.
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM w, range(1, {LONGEST + 1}) AS s(size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, size, f, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM c, range(1, {LONGEST}) AS s(k) WHERE k < size),
s AS (SELECT k.lang, k.phrase, k.size, k.f, k, x.f AS l, y.f AS r,
  (({FACTOR}::HUGEINT * k.f * k.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = head JOIN g y ON y.lang = k.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[a:a + z - 1], ' ') AS phrase, max(f) AS longer
  FROM c, range(2, {LONGEST}) AS u(z), range(1, {LONGEST}) AS v(a) WHERE z < size AND a + z - 1 <= size GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {COVERED} * f)
SELECT o.lang, rank, phrase, f AS a, l, r, n, score FROM (SELECT *, row_number() OVER (
  PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank FROM o) o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}"""
