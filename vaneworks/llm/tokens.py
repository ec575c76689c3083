"""Words of Arrow text columns as numpy arrays, for the operators that hash every word inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in groups of about so many bytes, whatever an Arrow batch holds.
CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(hashed: np.ndarray, n: int) -> np.ndarray:
    """64 bits of every run of n numbers."""
    out = np.zeros(max(0, len(hashed) - n + 1), dtype=np.uint64)
    for k in range(n if len(out) else 0):
        out = (out ^ hashed[k : len(hashed) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


class Chunk:
    """The words of some texts. ``rows``: their numbers in the batch; word ``w`` is bytes ``start[w]:end[w]`` of ``data`` and of text ``doc[w]``."""

    def __init__(self, rows: range, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds
        gap = _SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.ones(len(data), dtype=bool)
        before[1:] = gap[:-1]
        before |= edge[:-1]
        after = np.ones(len(data), dtype=bool)
        after[:-1] = gap[1:]
        after |= edge[1:]
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        #: First word of each text, and the number of words after the last.
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(rows)), np.diff(self.first))

    def hashes(self, lower: bool) -> np.ndarray:
        """64 bits of each word; with ``lower`` A-Z count as a-z."""
        data = _LOWER[self.data] if lower else self.data
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        # eight bytes of a word at a time, each mixed with its number in the word: sums of these have no pattern to collide by
        lanes = (self.end - self.start + 7) >> 3
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        word = np.repeat(np.arange(len(lanes)), lanes)
        number = np.arange(len(word)) - first[word]
        at = self.start[word] + 8 * number
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))[at]
        beyond = np.maximum(0, 8 - (self.end[word] - at)).astype(np.uint64) * np.uint64(8)
        eight = eight << beyond >> beyond  # bytes behind the word go
        total = np.add.reduceat(mix(eight + mix((number + 1).astype(np.uint64) * _STEP)), first)
        return mix(total ^ mix((self.end - self.start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))

    def ngrams(self, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of every run of n words inside one text, and the word at which it starts."""
        out = runs(hashed, n)
        at = np.flatnonzero(self.doc[: len(out)] == self.doc[n - 1 :]) if len(out) else np.zeros(0, np.int64)
        return out[at], at

    def text(self, a: int, b: int) -> bytes:
        """Words a ... b-1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in order, null ones as empty, in groups of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, len(texts))
        yield Chunk(range(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def group_sets(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted; and where each document's begin (n + 1 numbers)."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(n + 1))
