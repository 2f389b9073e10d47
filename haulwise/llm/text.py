"""Words and lines of whole texts as numpy arrays, for work inside Arrow batches.

A word is a run of characters outside ``\\x20`` and ``\\x09-\\x0D``. Words are named
by 64-bit hashes of their UTF-8 bytes, computed for a whole slice of texts at a
time. Memory is bounded by slices of rows (``SLICE_BYTES`` of text, or one longer
text) and, inside them, by ``SEGMENT`` bytes of hashing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SEGMENT = 2 << 20

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_U = np.uint64


def _table(pairs: dict[int, int], fill: int | None = None) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8) if fill is None else np.full(256, fill, np.uint8)
    for k, v in pairs.items():
        t[k] = v
    return t


SPACE = _table({32: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1}, 0).astype(bool)
LOWER = _table({c: c + 32 for c in range(65, 91)})
SAME = _table({})


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit of the result is usable."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + mix(b))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 1)
        _powers[:] = []
        for r in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, _U(r))
            p[0] = 1
            np.cumprod(p, out=p)
            _powers.append(p)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts: ``start``/``end`` byte places, ``first[d]:first[d+1]`` the words of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> None:
        data, offs = raw(texts)
        self.data, self.offs = data, offs
        solid = ~space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        before = np.ones(len(data), bool)
        after = np.ones(len(data), bool)
        if len(data):
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | cut[:-1]))
        self.end = np.flatnonzero(solid & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.fold = LOWER if lower else SAME

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, self.fold)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of every byte span; spans are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _power(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((fold[data[a:b]].astype(np.uint64) + _U(1)) * up[:b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xA0761D6478BD642F)
        i = j
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``budget`` bytes of text (or one longer row)."""
    for batch in batches:
        _, offs = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + budget, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
