"""Vectorised helpers for text inside tasks: byte buffers, words, hashes, runs.

Every helper works on a piece of an Arrow batch (some rows, a few MB of UTF-8), so a task's memory is
bounded by the piece and by its longest single text, never by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19

U = np.uint64
_rng = np.random.default_rng(20240229)
#: One odd 64-bit number for each byte value; the base of the rolling hashes and its inverse modulo 2**64.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(spec: str) -> np.ndarray:
    """A 256-entry mask of the bytes that belong to words; ``space``: all but white space, ``alnum``: letters, digits, non-ASCII."""
    mask = np.zeros(256, dtype=bool)
    if spec == "space":
        mask[:] = True
        mask[[32, 9, 10, 11, 12, 13]] = False
    elif spec == "alnum":
        mask[48:58] = mask[97:123] = mask[65:91] = mask[128:] = True
    else:
        raise ValueError(spec)
    return mask


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def times(a: int, b: int) -> np.uint64:
    """Product modulo 2**64."""
    return U(a * b % 2**64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a longer text stays whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = U(1)
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * PIECE_BYTES:  # a single very long text: not kept
            return made
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's offsets among the words; words end where their row ends."""
    w = is_word[buf]
    before = np.zeros(len(w), dtype=bool)
    before[1:] = w[:-1]
    inner = off[:-1][off[:-1] < len(w)]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), dtype=bool)
    after[:-1] = w[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes (across rows too; the caller cuts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, U(size), dtype=np.uint64)
    for j in range(size):
        out *= BASE
        out += words[j: j + n]
        out ^= out >> U(29)
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the n positions inside any of the spans."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
