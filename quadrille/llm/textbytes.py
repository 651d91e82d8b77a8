"""Words and shingles of whole Arrow batches, as numpy arrays over their UTF-8 bytes.

All separators used here are ASCII, so words can be found in bytes. Every hash is a fixed function of the bytes: equal
on each executor and in each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BYTE = mix(np.arange(1, 257, dtype=U64) * GOLDEN) | U64(1)
_BASE, _BASE_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, where, what = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = max(row + 1, min(end, rows))
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word ends with its row."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    after[borders - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by differences of a running polynomial sum."""
    out = np.empty(len(start), U64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + PIECE, "right")))
        lo, hi = int(start[first]), int(end[last - 1])
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        s, e = start[first:last] - lo, end[first:last] - lo
        out[first:last] = mix((sums[e] - sums[s]) * _power(_BASE_INVERSE, hi - lo)[s] + (e - s).astype(U64) * GOLDEN)
        first = last
    return out


def grams(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each index in `at` on."""
    out = np.full(len(at), mix(np.full(1, k, U64) * GOLDEN)[0])
    for j in range(k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + hashes[at + j])
    return out


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles; a row of fewer words has one, the whole sequence."""
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    at = np.arange(len(hashes))
    full = at[at - first[row] <= count[row] - k]
    out, of = [grams(hashes, full, k)], [row[full]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        out.append(grams(hashes, first[short], n))
        of.append(short)
    hash_, of_ = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of_, kind="stable")
    return hash_[order], of_[order]
