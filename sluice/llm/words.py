"""Words of many texts at once, as numpy arrays over an Arrow batch.

A word is a maximal run of bytes other than space and ``\\t..\\r``
(``[^\\x20\\x09-\\x0D]+``). Words are hashed eight bytes at a time, each step mixed with what came before (words of up to
eight bytes and of one length have different hashes), so no Python object is made for a word; very long words go through BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Words of more bytes are hashed one by one; others some at a time.
LONG, CHUNK = 512, 1 << 16
_START, _STEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts; text ``i`` has the words ``first[i]:first[i + 1]``."""

    rows: slice
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP + _START)
    if not len(size):
        return out
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    for some in range(0, len(size), CHUNK):
        at = some + np.flatnonzero(size[some : some + CHUNK] <= LONG)
        done = 0
        while len(at):
            x = eight[start[at] + done]
            left = size[at] - done
            short = left < 8
            x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
            out[at] = mix(out[at] * _STEP ^ x)
            at, done = at[left > 8], done + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8, key=b"sluice").digest(), "little")
    return out


def texts_of(column: pa.Array, limit: int = 16 * BLOCK) -> Iterator[tuple[slice, list[str]]]:
    """The texts of ``column``, up to ``limit`` bytes at a time (one text at least); null is empty."""
    data, at = buffers(column)
    view, i, n = memoryview(data), 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1))
        yield slice(i, j), [str(view[a:b], "utf-8", "replace") for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist())]
        i = j


def words_of(column: pa.Array, lower: bool = False, hashed: bool = True, limit: int = 4 * BLOCK) -> Iterator[Words]:
    """Words of the texts in ``column``, for a few MB of texts at a time (one text at least)."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(at[i]), int(at[j])
        part = data[lo:hi]
        if lower:
            part = _LOWER[part]
        offsets = at[i : j + 1] - lo
        inside = ~_SPACE[part]
        before = np.empty(len(part), dtype=bool)
        after = np.empty(len(part), dtype=bool)
        if len(part):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edge = offsets[(offsets > 0) & (offsets < len(part))]
            before[edge], after[edge - 1] = False, False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Words(
            slice(i, j),
            np.searchsorted(start, offsets),
            start,
            end,
            _hash(part, start, end) if hashed else None,
            part,
            offsets,
        )
        i = j


_ODD = np.array(
    [
        0xD6E8FEB86659FD93,
        0xA0761D6478BD642F,
        0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3,
        0x589965CC75374CC3,
        0x1D8E4E27C47D124F,
        0xEB44ACCAB455D165,
        0x9E6C63D0676A9A99,
    ],
    dtype=np.uint64,
)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words of one sequence; empty if it is shorter."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = (total + h[k : k + n]) * _ODD[k % len(_ODD)]
    return mix(total)


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingles of one text's word hashes, sorted; a shorter text is one shingle."""
    if len(h) == 0:
        return h
    if len(h) < width:
        return mix(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, width))
