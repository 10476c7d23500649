"""Vectorised reading of text columns inside tasks: batches by size, and 64-bit hashes of words.

A word is a longest run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text. A
word's hash does not depend on where it stands, so texts of any length are hashed in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C17)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD = np.array([chr(b).isalnum() or b == 95 or b >= 128 for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_ODD), BLOCK_BYTES * 2)
_DOWN = _powers(pow(int(_ODD), -1, 1 << 64), BLOCK_BYTES * 2)


class Words(NamedTuple):
    """Hashes of all words of a column, the row of each, and where it starts and ends in ``data`` (lower-cased bytes)."""
    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def as_text(column: pa.Array) -> pa.Array:
    """The column as text; null is the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column without copying."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data or b"", np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``size`` bytes, or one row, and at most ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start, at = np.concatenate([[0], np.cumsum(lengths)]), 0, 0
        while start < batch.num_rows:
            at = min(start + rows, max(start + 1, int(np.searchsorted(total, total[start] + size, "right")) - 1))
            yield batch.slice(start, at - start)
            start = at


def hash_words(column: pa.Array, inside: np.ndarray = _WORD, lower: bool = True) -> Words:
    """Hash every word of a text column; ``inside`` marks the bytes that words are made of."""
    offsets, data = buffers(pc.utf8_lower(as_text(column)) if lower else as_text(column))
    first, last = int(offsets[0]), int(offsets[-1])
    is_start = np.zeros(last - first + 1, bool)
    is_start[offsets - first] = True
    parts, at = [], first
    while at < last:
        end = min(at + BLOCK_BYTES, last)
        while end < last and inside[data[end]] and not is_start[end - first]:  # to the end of the word at the edge
            step = data[end:end + 4096]
            stop = ~inside[step] | is_start[end - first:end - first + len(step)]
            end += int(np.argmax(stop)) if stop.any() else len(step)
        parts.append(_hash_block(data[at:end], is_start[at - first:end - first + 1], at, inside))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts)) if parts else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Words(hashes, rows, starts, ends, data, offsets)


def _hash_block(block: np.ndarray, row_start: np.ndarray, base: int, kinds: np.ndarray):
    inside = kinds[block]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | row_start[1:-1]
    closes[:-1] &= ~inside[1:] | row_start[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    n = len(block)
    up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(int(_ODD), n), _powers(pow(int(_ODD), -1, 1 << 64), n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[block] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), starts + base, ends + base


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and their rows; a row of fewer words has one run of all its words."""
    total = len(words.hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(words.rows, minlength=len(words.offsets) - 1)
    acc = np.zeros(max(0, total - n + 1), np.uint64)
    for i in range(n if len(acc) else 0):
        acc = mix(acc * _ODD + words.hashes[i:total - n + 1 + i])
    whole = words.rows[:len(acc)] == words.rows[n - 1:] if len(acc) else np.zeros(0, bool)
    hashes, rows = acc[whole], words.rows[:len(acc)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(words.rows, short)
        out = np.zeros(len(short), np.uint64)
        for i in range(n):
            here = counts[short] > i
            out[here] = mix(out[here] * _ODD + words.hashes[first[here] + i])
        hashes, rows = np.concatenate([hashes, mix(out + counts[short].astype(np.uint64))]), np.concatenate([rows, short])
    return hashes, rows


def prefix_hashes(words: Words, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in bytes, the words longer than it (by index) and the hashes of that many first bytes."""
    sizes = words.ends - words.starts
    some = np.arange(len(sizes))
    acc = np.zeros(len(sizes), np.uint64)
    for i in range(max(lengths)):
        keep = sizes[some] > i + 1
        some, acc = some[keep], acc[keep]
        acc = mix(acc * _ODD + _BYTE[words.data[words.starts[some] + i]])
        if i + 1 in lengths:
            yield some, mix(acc + np.uint64(i + 1))


def group_starts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in an array that is ordered by them."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for 64-bit hashes sorting is far quicker than numpy's hashing."""
    values = np.sort(values)
    return values[group_starts(values)]
