"""Words of whole texts as numpy arrays, for the Arrow batches that Spark hands to a task.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so UTF-8 texts can be cut at
byte level. Words, and windows of consecutive words, are told apart by 64-bit hashes
(a keyed polynomial over bytes or words, finished with a bit mixer).

``text_slices`` walks a batch in pieces of about a megabyte of text, so memory in a
task depends on the longest single document and not on how many rows a batch has.
A null text is an empty one: it has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[ord("A"): ord("Z") + 1] += 32

_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (works in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown when needed."""

    def __init__(self, base: int) -> None:
        self.pair = tuple(np.array([1], np.uint64) for _ in range(2))
        self.bases = (base, pow(base, -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pair[0]) < n:
            size = 1 << (n - 1).bit_length()
            grown = []
            for base in self.bases:
                row = np.full(size, base, np.uint64)
                row[0] = 1
                grown.append(np.multiply.accumulate(row))
            self.pair = tuple(grown)
        return self.pair


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span ``data[start:end]``; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        piece = data[base: int(ends[j - 1])]
        power, inverse = _byte_powers.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[piece] * power[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


@dataclass
class Slice:
    """Some consecutive rows of a batch: text bytes, byte bounds and word bounds of each row."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray  # byte offset of each row, and the end
    starts: np.ndarray  # of words
    ends: np.ndarray
    rows: np.ndarray    # index of the first word of each row, and the number of words

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row]: self.bounds[row + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; nulls have no bytes."""
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def text_slices(column: pa.Array, letters: np.ndarray = PLAIN, blank: np.ndarray = BLANK) -> Iterator[Slice]:
    """Slices of about ``SLICE_BYTES`` (one row at least); ``letters`` maps bytes, ``blank`` marks separators."""
    if not len(column):
        return
    data, bounds = column_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, len(column))
        piece = data[bounds[i]: bounds[j]]
        if letters is not PLAIN:
            piece = letters[piece]
        yield cut(piece, bounds[i: j + 1] - bounds[i], i, blank)
        i = j


def cut(data: np.ndarray, bounds: np.ndarray, first_row: int = 0, blank: np.ndarray = BLANK) -> Slice:
    inside = ~blank[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    opens = inside & ~before[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & ~opens[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return Slice(first_row, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` words that lie in one row: (first word, hash), and where each row's windows begin."""
    counts = np.maximum(np.diff(rows) - (length - 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(rows[:-1] - begin[:-1], counts)
    power, inverse = _word_powers.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    found = (sums[at + length] - sums[at]) * inverse[at] + np.uint64(length)
    return at, mix(found), begin
