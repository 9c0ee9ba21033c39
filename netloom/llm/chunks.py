"""Encode texts through their distinct chunks: each chunk is encoded once and then looked up."""

from collections.abc import Callable
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

from netloom.llm.common import gather


class ChunkCache:
    """Ids of chunks, kept up to ``limit`` chunks or ``8 * limit`` characters; beyond that it starts anew.

    ``encode_many`` takes distinct chunks and returns (lengths, ids), both flat arrays.
    """

    def __init__(self, encode_many: Callable, limit: int = 700_000):
        self.encode_many, self.limit = encode_many, limit
        self._clear()

    def _clear(self):
        self.index, self.chars = {}, 0
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def get(self, chunk: str):
        """Ids of a chunk seen before, else None."""
        row = self.index.get(chunk)
        return None if row is None else self.ids[self.starts[row] : self.starts[row] + self.lengths[row]].tolist()

    def _learn(self, new: list):
        lengths, ids = self.encode_many(new)
        lengths = np.asarray(lengths, dtype=np.int64)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.asarray(ids, dtype=np.int32)])
        self.chars += sum(map(len, new))

    def _rows(self, chunks: list, distinct: bool = False) -> np.ndarray:
        """Row numbers of chunks, learning those that are new. Those of ``distinct`` chunks follow from their order."""
        if len(self.index) > self.limit or self.chars > 8 * self.limit:
            self._clear()
        rows = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = rows < 0
        if unknown.any():
            new, first = list(compress(chunks, unknown.tolist())), len(self.index)
            self._learn(new if distinct else list(dict.fromkeys(new)))
            rows[unknown] = np.arange(first, first + len(new)) if distinct else [self.index[c] for c in new]
        return rows

    def _flat(self, rows: np.ndarray, counts) -> tuple:
        lengths = self.lengths[rows]
        ids = gather(self.ids, self.starts[rows], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(np.asarray(counts, dtype=np.int64))
        return np.diff(ends[np.concatenate([[0], last])]), ids

    def encode(self, chunks: list, counts: list) -> tuple:
        """(ids per text, all ids) of texts that consist of ``counts`` chunks each."""
        return self._flat(self._rows(chunks), counts)

    def encode_lists(self, lists: pa.ListArray, prefix: str = "") -> tuple:
        """The same for an Arrow list of chunks per text; ``prefix`` goes before each chunk."""
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        rows = self._rows([prefix + c for c in chunks] if prefix else chunks, distinct=True)
        return self._flat(rows[np.asarray(coded.indices)], np.asarray(lists.value_lengths()))
