"""Words of many texts at once, as numpy arrays, for use inside tasks.

A batch of texts is one byte buffer with offsets. Words are found by a mask over the buffer and
hashed eight bytes at a time, so no Python object is made per word. Batches are cut into pieces of
a few megabytes; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from signalloom.llm.kept import trimmed

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text after which freed memory goes back to the system.
TRIM = 8 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of the texts ``offsets[i]:offsets[i + 1]`` of ``data``: runs without the bytes marked in ``gap``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        solid = ~gap[data]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        #: Words of text i are ``first[i]:first[i + 1]``.
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` ignores the case of A to Z."""
        data = _LOWER[self.data] if lower else self.data
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        length = self.ends - self.starts
        h = mixed(length.astype(np.uint64) * _M1 + np.uint64(seed))
        rest, at, todo = length, self.starts, None
        while len(at):
            part = np.ascontiguousarray(eight[at]).view(np.uint64).ravel()
            short = np.maximum(8 - rest, 0).astype(np.uint64) * np.uint64(8)
            part = (part << short) >> short
            if todo is None:
                h = mixed((h ^ part) * _M1)
                todo = np.flatnonzero(rest > 8)
                at, rest = at[todo] + 8, rest[todo] - 8
            else:
                h[todo] = mixed((h[todo] ^ part) * _M1)
                more = rest > 8
                todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
        return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * _M1 + h[i : i + n]
        out ^= out >> np.uint64(32)
    return mixed(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of ``batches`` in parts of about ``size`` bytes of text, with the texts' buffers."""
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(text))
        low, since = 0, since + len(data)
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
            a, b = offsets[low], offsets[high]
            yield batch.slice(low, high - low), data[a:b], offsets[low : high + 1] - a
            low = high
        del data, offsets
        if since > TRIM:
            since = 0
            trimmed()
    trimmed()
