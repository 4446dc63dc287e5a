"""Words of many texts at once: boundaries and 64-bit hashes with numpy.

Words are maximal runs of characters other than space and \\x09-\\x0D. All work is
on the UTF-8 bytes of an Arrow column, in blocks of bounded size, so a batch costs
a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64)  # a copy
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)


_BYTE = stream(256, 11)
_PLACE = stream(1 << 12, 12) | np.uint64(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[marks[0] : marks[-1]]
    return raw, marks - marks[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `most` bytes of text; a longer row stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    _, marks = column_bytes(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(marks, marks[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words of a column: byte ranges, and per row the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # n + 1 word offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def text(self, which: np.ndarray) -> bytes:
        """Chosen words, joined by one space."""
        return b" ".join(
            self.data[s:e].tobytes() for s, e in zip(self.starts[which], self.ends[which], strict=True)
        )


def find_words(column: pa.Array) -> Words:
    data, marks = column_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(marks), np.int64))
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[marks] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, marks))


def word_hashes(words: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word (multilinear over its bytes), A-Z lower-cased on demand."""
    n = len(words.starts)
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out
    sizes = words.ends - words.starts
    total = np.concatenate(([0], np.cumsum(sizes)))
    longest = int(sizes.max())
    place = _PLACE if longest <= len(_PLACE) else stream(longest, 12) | np.uint64(1)
    table = _BYTE[_LOWER] if lower else _BYTE
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK_BYTES, side="right")) - 1)
        size = sizes[at:to]
        first = total[at:to] - total[at]
        inner = np.arange(total[to] - total[at]) - np.repeat(first, size)
        bytes_at = inner + np.repeat(words.starts[at:to], size)
        terms = table[words.data[bytes_at]] * place[inner]
        out[at:to] = np.add.reduceat(terms, first)
        at = to
    out += sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if seed:
        out ^= stream(1, seed)[0]
    return mix(out)
