"""Vectorised word and shingle hashing over Arrow string columns.

A batch of texts is one byte array with offsets (Arrow's own layout); words, word
hashes and shingle hashes are numpy operations over the whole batch, so cost per
text is small and memory is bounded by the batch slice (``MAX_BYTES`` of text, or
one text if that is longer).

A word is a run of bytes outside space and 0x09-0x0D. Hashes are 64 bits; they are
only compared within a pair of documents or used to find candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 400_000

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Punctuation also ends a token: tokens are ASCII letters and digits and bytes from 0x80.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, MAX_BYTES + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span of bytes (or 64-bit symbols) follows in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _SHINGLE[63])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most max_bytes of text each, or one row."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: start, end, index of the text, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = _SPACE):
        n = len(data)
        space = delimiters[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= edge[:n]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after |= edge[1 : n + 1]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return span_hash(prefix_hash(self.data) if prefix is None else prefix, self.start, self.end)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; the caller drops those across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _SHINGLE[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bounds, words): each text's distinct k-word shingles, sorted.

    Texts with 1 to k - 1 words have one shingle, the whole sequence; texts without
    words have none.
    """
    words = Words(data, offsets)
    hashes = words.hashes()
    n = len(offsets) - 1
    every = windows(hashes, k)
    size = np.where(words.count >= k, words.count - k + 1, (words.count > 0).astype(np.int64))
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    out = np.zeros(bounds[-1], np.uint64)
    whole = words.count >= k
    if len(every):
        ok = words.doc[: len(every)] == words.doc[k - 1 :]
        long_rows = np.repeat(whole, size)
        out[long_rows] = every[ok]
    for d in np.flatnonzero((words.count > 0) & ~whole):
        part = hashes[words.first[d] : words.first[d + 1]]
        out[bounds[d]] = mix((part * _SHINGLE[8 : 8 + len(part)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(part)))[0]
    for d in np.flatnonzero(whole):
        out[bounds[d] : bounds[d + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][size > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[bounds], words.count
