"""SentencePiece-style unigram encoding and decoding over a double-array trie.

The pieces come from a model file. Their log scores follow Zipf's law in the file's
order (``log_scores``), as that file holds ranks and no probabilities. Encoding takes
the best-scoring segmentation (Viterbi); a character without a piece becomes byte
pieces. White space is kept as a marker, so decoding gives back the exact text.

No piece holds the marker after another character, nor a line end beside one, so each
chunk (markers and the characters behind them, or one line end) is segmented alone and
looked up when it repeats.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.chunks import ChunkCache
from netloom.llm.common import gather, list_array, plain_strings, release, runs, slices, table

MARK = "▁"
# Stands for a marker that the text itself holds; no other chunk has a line end before something else.
_OWN_MARK = "\n" + MARK
# A character that is no piece costs this much more than the worst piece.
UNKNOWN_COST = 10.0
# Chunks kept for later texts.
CACHED = 300_000
# Chunks up to this length are segmented many at a time.
WIDE = 64
MANY = 4096
# Texts are encoded in slices of about this many bytes.
CODED_BYTES = 1 << 20
_CHUNKS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def log_scores(count: int, shift: float = 10.0) -> np.ndarray:
    """Log probabilities of ranks 0 .. count - 1 under Zipf's law."""
    weights = 1.0 / (np.arange(count) + shift)
    return np.log(weights / weights.sum())


class DoubleArray:
    """Trie over code points: child of state s by character c is base[s] + code[c] if check says s."""

    def __init__(self, pieces: dict):
        chars = sorted({c for p in pieces for c in p})
        self.points = np.array([ord(c) for c in chars], dtype=np.int64)
        code = {c: i + 1 for i, c in enumerate(chars)}
        children: list = [{}]
        value = [-1]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                step = code[c]
                if step not in children[node]:
                    children[node][step] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][step]
            value[node] = number
        size = 2 * len(children) + 2 * len(chars) + 2
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        used = np.zeros(size, dtype=bool)
        used[0] = True
        place: dict = {}
        first = 1
        for node in sorted(range(len(children)), key=lambda n: (-len(children[n]), n)):
            if not children[node]:
                break
            steps = np.array(sorted(children[node]), dtype=np.int64)
            at = first
            while True:
                room = at + 4096 + len(self.points) + 2
                if room > len(used):
                    self._grow(2 * room)
                    used = np.concatenate([used, np.zeros(2 * room - len(used), dtype=bool)])
                free = np.flatnonzero(~used[at : at + 4096]) + at
                begins = free[free >= steps[0]] - steps[0]
                fits = begins[~used[begins[:, None] + steps[None, :]].any(1)] if len(steps) < 64 else [
                    b for b in begins if not used[b + steps].any()][:1]
                if len(fits):
                    break
                at += 4096
            begin = int(fits[0])
            used[begin + steps] = True
            place[node] = begin
            while used[first]:
                first += 1
        queue = [(0, 0)]
        for node, at in queue:
            self.value[at] = value[node]
            if children[node]:
                begin = place[node]
                self.base[at] = begin
                for step, child in children[node].items():
                    self.check[begin + step] = at
                    queue.append((child, begin + step))

    def _grow(self, size: int):
        for name, fill in (("base", 0), ("check", -1), ("value", -1)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(size - len(old), fill, dtype=np.int32)]))

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of code points; 0, which never leads anywhere, for characters of no piece."""
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == points, at + 1, 0).astype(np.int32)

    def child(self, state, code):
        """Next states, -1 where there is none."""
        to = self.base[state] + code
        return np.where((code > 0) & (self.check[to] == state), to, -1)


class Unigram:
    """Encoder and decoder; ``pieces[i]`` has id i and is a string, or an int for a byte piece, or None."""

    def __init__(self, pieces: list, scores: np.ndarray):
        self.pieces = pieces
        self.trie = DoubleArray({p: i for i, p in enumerate(pieces) if isinstance(p, str) and p})
        self.scores = np.asarray(scores, dtype=np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_COST
        self.bytes = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            if isinstance(p, int):
                self.bytes[p] = i
        raw = [bytes([p]) if isinstance(p, int) else (p or "").replace(MARK, " ").encode() for p in pieces]
        self.raw_length = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.cache = None

    @classmethod
    def from_model(cls, path: str) -> "Unigram":
        """Pieces of a model file in its order; control and unknown pieces take no part."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list = []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                pieces.append(int(text[1:-1], 16))
            else:
                pieces.append(None if model.is_control(i) or model.is_unknown(i) else text)
        own = cls(pieces, log_scores(len(pieces)))
        own.check_chunks()
        return own

    def check_chunks(self):
        """Chunks may be segmented alone only if no piece reaches over their edges."""
        for p in self.pieces:
            if isinstance(p, str) and (MARK in p.lstrip(MARK) or ("\n" in p and p != "\n")):
                raise ValueError(f"piece {p!r} spans chunks")

    # -- segmentation --------------------------------------------------------

    def _bytes_of(self, char: str) -> list:
        return self.bytes[list(char.encode("utf-8", "surrogatepass"))].tolist()

    def _one(self, chunk: str) -> list:
        """Viterbi over one chunk of any length."""
        codes = self.trie.codes(np.array([ord(c) for c in chunk], dtype=np.int64)).tolist()
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(chunk)
        best, back, by = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            state, single = 0, False
            for j in range(i, n):
                to = int(base[state]) + codes[j]
                if not codes[j] or check[to] != state:
                    break
                state = to
                piece = int(value[to])
                if piece >= 0:
                    single = single or j == i
                    score = best[i] + scores[piece]
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1], by[j + 1] = score, i, piece
            if not single and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1], by[i + 1] = best[i] + self.unknown, i, -1
        out: list = []
        while n:
            out.append([by[n]] if by[n] >= 0 else self._bytes_of(chunk[back[n]]))
            n = back[n]
        return [i for part in reversed(out) for i in part]

    def _many(self, chunks: list) -> list:
        """Viterbi over chunks of similar length, one character position at a time for all of them."""
        rows, width = len(chunks), max(map(len, chunks))
        lengths = np.array([len(c) for c in chunks])
        points = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.trie.codes(points.astype(np.int64)).reshape(rows, width)
        codes[np.arange(width)[None, :] >= lengths[:, None]] = 0
        best = np.full((rows, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((rows, width + 1), dtype=np.int32)
        by = np.full((rows, width + 1), -1, dtype=np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            at = np.flatnonzero(lengths > i)
            state, single = np.zeros(len(at), dtype=np.int32), np.zeros(rows, dtype=bool)
            for j in range(i, width):
                code = codes[at, j]
                to = base[state] + code
                ok = (code > 0) & (check[to] == state)
                at, state = at[ok], to[ok]
                if not len(at):
                    break
                piece = value[state]
                has = piece >= 0
                hit, piece = at[has], piece[has]
                if j == i:
                    single[hit] = True
                score = best[hit, i] + self.scores[piece]
                better = score > best[hit, j + 1]
                hit, piece = hit[better], piece[better]
                best[hit, j + 1], back[hit, j + 1], by[hit, j + 1] = score[better], i, piece
            bare = np.flatnonzero((lengths > i) & ~single)
            if len(bare):
                score = best[bare, i] + self.unknown
                bare = bare[score > best[bare, i + 1]]
                best[bare, i + 1], back[bare, i + 1], by[bare, i + 1] = best[bare, i] + self.unknown, i, -1
        found = np.full((rows, width), -2, dtype=np.int32)
        places = np.zeros((rows, width), dtype=np.int32)
        end, at = lengths.copy(), np.flatnonzero(lengths > 0)
        for slot in range(width - 1, -1, -1):
            if not len(at):
                break
            found[at, slot], places[at, slot] = by[at, end[at]], back[at, end[at]]
            end[at] = back[at, end[at]]
            at = at[end[at] > 0]
        return (found > -2).sum(1), found[found > -2], np.flatnonzero((found == -1).any(1))

    def encode_chunks(self, chunks: list) -> tuple:
        """(lengths, ids) of chunks, each segmented alone."""
        groups: dict = {}
        for k, c in enumerate(chunks):
            groups.setdefault((len(c) + 3) // 4 if len(c) <= WIDE else -1, []).append(k)
        alone = groups.pop(-1, [])
        order, counts, flat = [], [], []
        for members in groups.values():
            for a in range(0, len(members), MANY):
                part = np.array(members[a : a + MANY])
                lengths, ids, bare = self._many([chunks[k] for k in part])
                order.append(part)
                counts.append(lengths)
                flat.append(ids)
                alone += part[bare].tolist()
        for k in alone:  # long, or with byte pieces
            ids = np.array(self._one(chunks[k]), dtype=np.int32)
            order.append(np.array([k]))
            counts.append(np.array([len(ids)]))
            flat.append(ids)
        if not order:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        order, counts, flat = map(np.concatenate, (order, counts, flat))
        starts = np.cumsum(counts) - counts
        at = np.zeros(len(chunks), dtype=np.int64)
        at[order] = np.arange(len(order))  # of a chunk done twice, the later result holds
        return counts[at], gather(flat, starts[at], counts[at])

    @staticmethod
    def chunks(text: str) -> list:
        """Chunks of a text behind its leading marker; a marker in the text itself stays a chunk of its own."""
        if not text:
            return []
        if MARK in text:
            out = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    out.append(_OWN_MARK)
                    out += _CHUNKS.findall(part.replace(" ", MARK))
                else:
                    out += _CHUNKS.findall(MARK + part.replace(" ", MARK))
            return out
        return _CHUNKS.findall(MARK + text.replace(" ", MARK))

    def encode_texts(self, texts: pa.Array) -> tuple:
        """``encode_batch`` for an Arrow string array without nulls.

        Texts with single spaces only are cut at these by Arrow.
        """
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = np.asarray(pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.equal(texts, ""))))
        parts = []
        for a, b, v in runs(odd):
            part = texts.slice(a, b - a)
            if v:
                parts.append(self.encode_batch(part.to_pylist()))
            else:
                parts.append(self._cached().encode_lists(pc.split_pattern(part, " "), MARK))
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _cached(self) -> ChunkCache:
        if self.cache is None:
            self.cache = ChunkCache(self._encode_distinct, CACHED)
        return self.cache

    def encode_batch(self, texts: list) -> tuple:
        """(ids per text, all ids)."""
        split = [self.chunks(t) for t in texts]
        return self._cached().encode([c for s in split for c in s], [len(s) for s in split])

    def _encode_distinct(self, chunks: list) -> tuple:
        """Ids of distinct chunks; one that holds line ends is put together from its parts."""
        whole = {c: _CHUNKS.findall(c) for c in chunks if "\n" in c and c not in ("\n", _OWN_MARK)}
        parts = [whole.get(c, (c,)) for c in chunks]
        index = {p: k for k, p in enumerate(dict.fromkeys(p for row in parts for p in row))}
        single = [p for p in index if p != _OWN_MARK]
        lengths, ids = self.encode_chunks(single)
        if len(index) > len(single):  # a marker that the text itself holds
            k, marker = index[_OWN_MARK], self._bytes_of(MARK)
            ids = np.insert(ids, int(lengths[:k].sum()), marker)
            lengths = np.insert(lengths, k, len(marker))
        at = np.array([index[p] for row in parts for p in row], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum([len(row) for row in parts])])
        starts = np.cumsum(lengths) - lengths
        total = np.concatenate([[0], np.cumsum(lengths[at])])
        return np.diff(total[ends]), gather(ids, starts[at], lengths[at])

    def encode(self, text: str) -> list:
        return self.encode_batch([text])[1].tolist()

    def decode_batch(self, counts: np.ndarray, ids: np.ndarray) -> list:
        """Texts of id lists; the leading marker of each is dropped."""
        lengths = self.raw_length[ids]
        raw = gather(self.raw, self.raw_start[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list) -> str:
        return self.decode_batch(np.array([len(ids)]), np.array(ids, dtype=np.int64))[0]

    def __getstate__(self):
        return self.__dict__ | {"cache": None}


_loaded: dict = {}


def _model(path: str) -> Unigram:
    """The worker's model, built once from the vocabulary file every executor has."""
    if path not in _loaded:
        _loaded[path] = Unigram.from_model(path)
    return _loaded[path]


ENCODED = "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, decoded_chars long, exact boolean"


def _coder(path: str):
    def run(batches):
        model = _model(path)
        is_byte = np.array([isinstance(p, int) for p in model.pieces])
        for whole in batches:
            for batch in slices(whole, "text", CODED_BYTES):
                texts = plain_strings(batch["text"])
                counts, ids = model.encode_texts(texts)
                back = pa.array(model.decode_batch(counts, ids), pa.string())
                raw = np.concatenate([[0], np.cumsum(is_byte[ids])])
                edges = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], list_array(counts, pa.array(ids)), pa.array(counts),
                     pa.array(np.diff(raw[edges]).astype(np.int64)), pc.utf8_length(back).cast(pa.int64()), pc.equal(back, texts)],
                    names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded_chars", "exact"],
                )
            release()
        model.cache = None  # the worker keeps the model, not the chunks of a task's texts
        release()

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, decoded again to check the round trip.

    Returns one row per row of ``docs``: ``doc_id``, ``ids``, ``n_pieces``,
    ``n_byte_pieces``, ``decoded_chars`` and ``exact`` (decoding gave the text back).
    A null text counts as empty and has no ids. Null and repeated ids pass through;
    other columns are left out. A text is never cut, however long.
    """
    slim = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text")
    return slim.mapInArrow(_coder(model_path), ENCODED)


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
