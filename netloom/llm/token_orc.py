"""Token ids in ORC files: ordered by document, with row indexes and Bloom filters on ids.

``write_tokens`` range-partitions documents by id, encodes each partition in order and
writes one ORC file per partition. ORC stores the ids with its integer run-length
encoding, keeps minima and maxima per row group and a Bloom filter on ``doc_id``, and
Spark reads stripes in parallel and skips those a filter on ``doc_id`` rules out.
"""

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.chunks import ChunkCache
from netloom.llm.common import list_array, plain_strings, runs, slices
from netloom.llm.rank_bpe import check_file
from netloom.plans.sizing import scratch_path

END_ID = 2
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}
# Text for a file of ids, and files at most if the size is not known.
FILE_BYTES, MOST_FILES = 256 << 20, 1_000_000
# Python also splits at these, the tokenizer does not.
_SEPARATORS = "[\x1c-\x1f]"
# What a text must not hold to be put into lower case beforehand: characters behind Latin-1, and added tokens.
_KEEPS_CASE = r"[^\x{00}-\x{ff}]|<\|"
_BLANKS = re.compile("[ \n\r\t]+")
# Pre-tokens of a chunk of printable ASCII without upper case.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_caches: dict = {}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _chunk_lists(texts: pa.Array, odd: bool) -> pa.ListArray:
    """White-space chunks of texts. Tokens of this tokenizer never span white space and have no upper case.

    A text in Latin-1 that holds no added token in any case is put into lower case first, so
    that fewer chunks differ; whether it is depends on that text alone.
    """
    if odd:
        return pa.array([[c for c in _BLANKS.split(t) if c] for t in texts.to_pylist()], pa.list_(pa.string()))
    texts = pc.if_else(pc.match_substring_regex(texts, _KEEPS_CASE), texts, pc.utf8_lower(texts))
    return _without_empty(pc.utf8_split_whitespace(texts))


def _without_empty(lists: pa.ListArray) -> pa.ListArray:
    """Splitting leaves an empty chunk at a text's edges if it begins or ends with white space."""
    flat, counts = lists.flatten(), np.asarray(lists.value_lengths())
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if keep.all():
        return lists
    kept = np.concatenate([[0], np.cumsum(keep)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return list_array(np.diff(kept[edges]), flat.filter(pa.array(keep)))


def encode_texts(cache: ChunkCache, texts: pa.Array) -> tuple:
    """(ids per text, all ids) of an Arrow string array without nulls."""
    odd = np.asarray(pc.match_substring_regex(texts, _SEPARATORS))
    parts = [cache.encode_lists(_chunk_lists(texts.slice(a, b - a), v)) for a, b, v in runs(odd)]
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    return tuple(np.concatenate(p) for p in zip(*parts))


def word_encoder(path: str) -> ChunkCache:
    """The worker's cache of encoded chunks for a tokenizer file.

    A lower-case word of Latin-1 letters is one pre-token that normalisation leaves
    as it is, so it goes straight to the library's byte alphabet and merge model; a
    point or comma behind it is a pre-token of its own. A chunk of printable ASCII without
    upper case and added tokens is split at the pre-tokenizer's pattern. Every other chunk
    goes through the whole tokenizer. A file whose tokens could span white space or keep upper case, or
    whose added tokens do not begin with ``<|``, raises ValueError.
    """
    if path in _caches:
        return _caches[path]
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    if not all(token.startswith("<|") for token in check_file(path)):
        raise ValueError("an added token does not begin with <|")
    tokenizer = Tokenizer.from_file(path)
    merge, alphabet = tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False)
    whole = lambda chunk: tokenizer.encode(chunk, add_special_tokens=False).ids
    tails = {t: whole(t) for t in ".,"}

    def encode_many(chunks):
        # Millions of small lists and no cycles: the collector would only walk over them.
        collects = gc.isenabled()
        gc.disable()
        try:
            return learn(chunks)
        finally:
            if collects:
                gc.enable()

    def learn(chunks):
        lengths, ids, words = [], [], {}
        for chunk in chunks:
            tail = tails.get(chunk[-1:])
            base = chunk[:-1] if tail else chunk
            if base.isalpha() and base.islower() and (base.isascii() or _latin(base)):
                found = words.get(base)
                if found is None:
                    # Without a tail the word is the chunk, which the cache does not know.
                    found = tail and cache.get(base)
                    if not found:
                        letters = base if base.isascii() else alphabet.pre_tokenize_str(base)[0][0]
                        found = [t.id for t in merge(letters)]
                    words[base] = found
                if tail:
                    found = found + tail
            elif chunk.isascii() and chunk.isprintable() and chunk == chunk.lower() and "<|" not in chunk:
                found = []
                for piece in _PIECES.findall(chunk):
                    part = words.get(piece)
                    if part is None:
                        part = words[piece] = [t.id for t in merge(piece)]
                    found += part
            else:
                found = whole(chunk)
            lengths.append(len(found))
            ids += found
        return lengths, ids

    cache = _caches[path] = ChunkCache(encode_many)
    return cache


def _encoder(path: str, end_id: int):
    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, part, start = word_encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                counts, ids = encode_texts(cache, plain_strings(batch["text"]))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                counts = counts + 1
                ends = start + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), pa.array(np.full(len(counts), part, dtype=np.int32)),
                     pa.array(ends - counts), pa.array(counts), list_array(counts, pa.array(ids))],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start = int(ends[-1])

    return encode


def _files(rows: DataFrame) -> int:
    """Files by the size Spark expects of the rows, the shuffle partitions at least."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_FILES, size // FILE_BYTES))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> str:
    """Encode every whole text and write the ids to ORC files below ``path`` in id order.

    A null or empty text gives the end id alone. A null id comes first; rows with equal
    ids are ordered by text, so repeated rows give repeated rows. Other columns are left
    out. An empty table gives files without rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    count = partitions or _files(slim)
    ordered = slim.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA).write
    for key, value in ORC_OPTIONS.items():
        writer = writer.option(key, value)
    writer.orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The stored rows; ``doc_ids`` reaches the files as a filter and skips row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def part_offsets(rows: DataFrame) -> DataFrame:
    """(part, part_offset): ids in all files before a file; one row per file."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_offset"))


def _digests(batches):
    for batch in batches:
        lists = batch["ids"]
        values = np.asarray(lists.values, dtype="<u4")
        at = np.asarray(lists.offsets)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("doc_id", "part", "part_start", "n_tokens")], pa.array(crc, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, read from the files."""
    rows = read_tokens(spark, path)
    offsets = F.broadcast(part_offsets(rows))  # one row per file
    schema = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    return (
        rows.mapInArrow(_digests, schema)
        .join(offsets, "part")
        .select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"))
    return token_digests(spark, path)
