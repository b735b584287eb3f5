"""Vectorised word splitting and hashing over Arrow string columns (used inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = U64(int(_RNG.integers(1 << 62, 1 << 63)) | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at once; the temporary arrays take about forty times as much.
SLICE_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: U64, n: int) -> np.ndarray:
    kept = _POWERS.get(str(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        kept = _POWERS[str(base)] = np.cumprod(steps)
    return kept


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


#: Stands for a null id inside tasks.
NO_ID = -(1 << 63)


def id_values(column: pa.Array) -> np.ndarray:
    """An id column as integers, NO_ID for null."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about SLICE_BYTES each; a longer row stands alone."""
    at = 0
    while at < len(offs) - 1:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        yield at, end
        at = end


class Words:
    """The words of some rows: byte ranges, row of each word, 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool, space: np.ndarray = _SPACE, cut=None):
        """``cut(text)``, if given, marks bytes at which a new word begins even without a space."""
        base, text = int(offs[0]), data[int(offs[0]) : int(offs[-1])]
        rows = offs - base
        edge = np.zeros(len(text) + 1, bool)
        edge[rows[:-1]] = True
        edge[-1] = True
        if cut is not None:
            edge[:-1] |= cut(text)
        inside = ~space[text]
        before = np.empty(len(text), bool)
        before[:1], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(text), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(rows, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(rows) - 1).astype(np.int64)
        self.text = text
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[text] * _powers(_BASE, len(text))[: len(text)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * _powers(_INVERSE, len(text) + 1)[self.starts])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of k words; a row with fewer words has one of all its words."""
    h, row, n = words.hashes, words.row, len(words.hashes)
    if not n:
        return row, h
    first = np.cumsum(words.counts) - words.counts
    place = np.arange(n) - first[row]
    room = words.counts[row]
    at = np.flatnonzero((place <= room - k) | ((room < k) & (place == 0)))
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = at + j
        ok = place[at] + j < room[at]
        out = mix(out * U64(0x9E3779B97F4A7C15) + np.where(ok, h[np.minimum(there, n - 1)], U64(0)) + U64(j + 1))
    return row[at], out


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, by row and then value."""
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(block: bytes) -> list[np.ndarray]:
    """The arrays that ``pack`` was given."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)[1:].reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for kind, n in head:
        dtype = np.dtype(chr(kind))
        size = int(n) * dtype.itemsize
        block_ = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, int(n))
        out.append(np.ascontiguousarray(block_.T).view(dtype).reshape(-1))
        at += size
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + count), one range after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass
