"""Byte-pair encoding and decoding with contiguous rank arrays.

A text is cut into white-space chunks, these into pre-tokens, and every distinct chunk is
encoded once. Short words are merged many at a time: a row holds the ids of a word's
parts side by side and the ranks of the pairs they form. Each step scans the ranks for the
smallest one (the leftmost of equals), deletes the boundary behind it and looks up the
ranks of the two pairs that have changed. Words too long for a scan per merge keep their
pairs in a heap instead and give the same ids.
"""

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.chunks import ChunkCache
from netloom.llm.common import gather, list_array, plain_strings, release, slices, table

# Words of up to this many bytes are merged by scans.
SHORT = 64
# Words merged in one go, texts coded in one go, and chunks a worker remembers.
MANY = 4096
CODED_BYTES = 2 << 20
CACHED = 500_000
_NONE = np.iinfo(np.int32).max
# Pre-tokens of an ASCII chunk in lower case: the pattern of the tokenizer file without its other letters.
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# The normaliser and pre-tokenizer of a file whose tokens never span white space.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENCODED = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> list:
    """The letter that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def check(spec: dict) -> None:
    """Raise ValueError for a tokenizer file that needs what coding by white-space chunks does not do."""
    model = spec["model"]
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [{}])
    fine = (
        model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and normal.get("normalizers") == _NORMAL and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and not spec.get("decoder") and not spec.get("post_processor")
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )
    if not fine:
        raise ValueError("the tokenizer file needs what this coder does not do")


def check_file(path: str) -> list:
    """The added tokens of a tokenizer file that passes ``check``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check(spec)
    return [t["content"] for t in spec["added_tokens"]]


class RankBpe:
    """Encoder and decoder made from a tokenizer file.

    Taken are byte-level BPE files without dropout, unknown token and byte fallback, whose
    normaliser and pre-tokenizer are those above, whose decoder is absent (tokens joined by
    spaces) and whose added tokens are plain strings without white space. Others raise ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        model, letters = spec["model"], byte_letters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {letter: b for b, letter in enumerate(letters)}
        # Two alphabets: bytes inside a word and a word's last byte.
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[m[side]] for m in merges], dtype=np.int64) for side in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.span = max(vocab.values()) + 1
        # A pair listed twice has its later rank.
        order = np.lexsort((-np.arange(len(merges)), left * self.span + right))
        keys = (left * self.span + right)[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
        self.pairs, self.rank_of = np.append(keys[first], -1), np.append(order[first], 0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        tokens = [""] * (max([self.span - 1, *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        self.cache = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; _NONE where they do not merge."""
        keys = left * self.span + right
        at = np.searchsorted(self.pairs[:-1], keys)
        return np.where(self.pairs[at] == keys, self.rank_of[at], _NONE)

    def merge_short(self, parts: np.ndarray, lengths: np.ndarray) -> tuple:
        """(lengths, ids) of words after all merges; row i of ``parts`` holds ``lengths[i]`` ids side by side."""
        width = parts.shape[1]
        lengths = lengths.copy()
        done, ids = lengths.copy(), np.full(parts.shape, -1, dtype=np.int64)
        ranks = np.full((len(parts), max(width, 2)), _NONE, dtype=np.int64)  # of part j with part j + 1
        ranks[:, : width - 1] = self.ranks(parts[:, :-1], parts[:, 1:])
        ranks[np.arange(ranks.shape[1])[None, :] >= (lengths - 1)[:, None]] = _NONE
        rows = np.arange(len(parts))  # the words that still merge
        while len(rows):
            best = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), best]
            going = low < _NONE
            if not going.all():
                over = ~going
                ids[rows[over], : parts.shape[1]], done[rows[over]] = parts[over], lengths[over]
                rows, parts, ranks, lengths, best, low = (x[going] for x in (rows, parts, ranks, lengths, best, low))
                continue
            at = np.arange(len(rows))
            parts[at, best] = self.made[low]
            # The boundary behind the merged part goes: all that follows moves up by one place.
            place = np.arange(parts.shape[1])[None, :]
            parts = np.take_along_axis(parts, np.minimum(place + (place > best[:, None]), parts.shape[1] - 1), 1)
            place = np.arange(ranks.shape[1])[None, :]
            ranks = np.take_along_axis(ranks, np.minimum(place + (place > best[:, None]), ranks.shape[1] - 1), 1)
            lengths = lengths - 1
            ranks[at, np.maximum(lengths - 1, 0)] = _NONE
            for j, some in ((best - 1, best > 0), (best, best < lengths - 1)):
                some = at[some]
                ranks[some, j[some]] = self.ranks(parts[some, j[some]], parts[some, j[some] + 1])
        return done, ids[np.arange(width)[None, :] < done[:, None]]

    def merge_long(self, parts: list) -> list:
        """The same for one word of any length, with its pairs in a heap."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.ranks(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), j) for j, r in enumerate(found) if r < _NONE]
        heapq.heapify(heap)
        rank = found.tolist() + [_NONE]

        def refresh(j):
            right = after[j]
            rank[j] = _NONE if right >= n else int(self.ranks(np.array([parts[j]]), np.array([parts[right]]))[0])
            if rank[j] < _NONE:
                heapq.heappush(heap, (rank[j], j))

        while heap:
            r, j = heapq.heappop(heap)
            if parts[j] is None or rank[j] != r:
                continue  # changed since
            gone = after[j]
            parts[j], parts[gone] = int(self.made[r]), None
            after[j] = after[gone]
            if after[j] < n:
                before[after[j]] = j
            refresh(j)
            if before[j] >= 0:
                refresh(before[j])
        return [p for p in parts if p is not None]

    def _parts(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, dtype=np.uint8)
        parts = self.inner[raw]
        parts[-1] = self.last[raw[-1]]
        return parts

    def encode_words(self, words: list) -> tuple:
        """(lengths, ids) of words given as bytes; none is empty."""
        by_size: dict = {}
        for k, w in enumerate(words):
            by_size.setdefault((len(w) + 3) // 4 if len(w) <= SHORT else -1, []).append(k)
        long = by_size.pop(-1, [])
        order, counts, flat = [], [], []
        for members in by_size.values():
            for a in range(0, len(members), MANY):
                some = members[a : a + MANY]
                lengths = np.array([len(words[k]) for k in some])
                width = int(lengths.max())
                raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in some]), dtype=np.uint8)
                raw = raw.reshape(len(some), -1)
                parts = self.inner[raw]
                at = np.arange(len(some))
                parts[at, lengths - 1] = self.last[raw[at, lengths - 1]]
                lengths, ids = self.merge_short(parts, lengths)
                order.append(some)
                counts.append(lengths)
                flat.append(ids)
        for k in long:
            ids = self.merge_long(self._parts(words[k]).tolist())
            order.append([k])
            counts.append([len(ids)])
            flat.append(ids)
        if not order:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        order, counts, flat = (np.concatenate(x).astype(np.int64) for x in (order, counts, flat))
        starts, at = np.cumsum(counts) - counts, np.empty(len(words), dtype=np.int64)
        at[order] = np.arange(len(order))
        return counts[at], gather(flat, starts[at], counts[at])

    def words(self, piece: str) -> list:
        """Pre-tokens of a chunk without special tokens, as bytes.

        A chunk in ASCII needs lower case and the pattern alone; others go through the
        library's normaliser and pre-tokenizer.
        """
        if piece.isascii():
            return [w.encode() for w in _ASCII.findall(piece.lower())]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.split(self.normalise(piece))]

    def encode_chunks(self, chunks: list) -> tuple:
        """(lengths, ids) of white-space chunks: special tokens and the words between them."""
        index, plan, plans = {}, [], []
        for chunk in chunks:
            pieces = self.cut.split(chunk) if self.cut else [chunk]
            count = len(plan)
            for k, piece in enumerate(pieces):
                if k % 2:
                    plan.append(-1 - self.special[piece])
                elif piece:
                    plan += [index.setdefault(w, len(index)) for w in self.words(piece)]
            plans.append(len(plan) - count)
        lengths, ids = self.encode_words(list(index))
        plan = np.array(plan, dtype=np.int64)
        # Special tokens follow the words as words of one id.
        extra = np.unique(-1 - plan[plan < 0])
        starts = np.concatenate([np.cumsum(lengths) - lengths, len(ids) + np.arange(len(extra))])
        lengths = np.concatenate([lengths, np.ones(len(extra), dtype=np.int64)])
        ids = np.concatenate([ids, extra])
        row = np.where(plan < 0, len(index) + np.searchsorted(extra, -1 - plan), plan)
        ends = np.concatenate([[0], np.cumsum(lengths[row])])
        edges = np.concatenate([[0], np.cumsum(plans)]).astype(np.int64)
        return np.diff(ends[edges]), gather(ids, starts[row], lengths[row])

    def encode_texts(self, texts: pa.Array) -> tuple:
        """(ids per text, all ids) of an Arrow string array without nulls."""
        if self.cache is None:
            self.cache = ChunkCache(self.encode_chunks, CACHED)
        lists = pc.ascii_split_whitespace(texts)
        # Splitting leaves empty chunks at the edges of a text; they have no ids.
        return self.cache.encode_lists(lists)

    def encode(self, text: str) -> list:
        return self.encode_texts(pa.array([text]))[1].tolist()

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists, special tokens kept: the tokens joined by spaces."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")

    def decode(self, ids: list) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def __getstate__(self):
        raise TypeError("made on each worker from its file")


_loaded: dict = {}


def coder(path: str) -> RankBpe:
    """The worker's coder, made once from the tokenizer file every executor has."""
    if path not in _loaded:
        _loaded[path] = RankBpe(path)
    return _loaded[path]


def _code(path: str):
    def run(batches):
        bpe = coder(path)
        for whole in batches:
            for batch in slices(whole, "text", CODED_BYTES):
                counts, ids = bpe.encode_texts(plain_strings(batch["text"]))
                lists = list_array(counts, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, bpe.decode_lists(lists)],
                                                 names=["doc_id", "ids", "decoded"])
            release()
        bpe.cache = None  # the worker keeps the tables, not the chunks of a task's texts
        release()

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text: its token ids and the text these decode to.

    One row per row of ``docs``. A null text counts as empty and has no ids; special tokens
    in a text get their ids. Null and repeated ids pass through; other columns are left out.
    An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_code(tokenizer_path), ENCODED)


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
