"""Vectorised text primitives over Arrow string columns.

A string column is one UTF-8 byte buffer with offsets.  Words, n-grams and
lines are found and hashed with whole-array numpy operations on that buffer;
there is no Python loop per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21  # bytes hashed at once; longer texts are cut between words
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n, by doubling; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1024), dtype=np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return raw, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer one stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def byte_set(members: bytes | set | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SPACE = byte_set({0x20, *range(0x09, 0x0E)})
NOT_SPACE = ~SPACE
#: Words for decontamination, after A-Z is lowered: 0-9, a-z and all that isn't ASCII.
ALNUM = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross a document's border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of these disjoint ascending byte spans.

    A polynomial in an odd base modulo 2**64: one running sum over the block
    gives every span's sum by a difference, and the inverse of the base moves
    it to the origin.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        to = int(np.searchsorted(ends, origin + BLOCK, side="right"))
        to = max(to, at + 1)
        n = int(ends[to - 1]) - origin
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[raw[origin : origin + n]] * _power(_BASE, n), out=sums[1:])
        s, e = starts[at:to] - origin, ends[at:to] - origin
        out[at:to] = (sums[e] - sums[s]) * _power(inverse, n + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def words(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each document plus their number)."""
    starts, ends = spans(members[raw], offsets)
    return starts, ends, hash_spans(raw, starts, ends), np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of each window of n words inside a document."""
    total = len(hashes)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = np.ones(total, dtype=bool)
    for k in range(1, n):
        tail = first[1:] - k
        ok[tail[(tail >= first[:-1]) & (tail >= 0)]] = False
    at = np.flatnonzero(ok[: total - n + 1])
    value = np.zeros(total - n + 1, dtype=np.uint64)
    for k in range(n):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[k : total - n + 1 + k]
    return at, mix(value[at])


def one_hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])
