"""SetSketch registers: exponentially spaced, truncated minima of exponential variates.

Every element runs a Poisson process whose points fall on random registers; a register keeps its earliest point x and
stores floor(offset - log_b x), truncated to 0..limit. Earliest points of a union are the minimum of the parts', so
registers merge by maximum. Two registers agree about as often as the sets overlap, which makes bands of them
locality-sensitive; the counts of larger, smaller and equal registers give a joint likelihood of the overlap.
"""

from __future__ import annotations

import numpy as np

from .textbytes import GOLDEN, U64, mix

BASE = 1.005
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
#: Points are sums of whole multiples of 2 ** -40, so their order of summation doesn't matter.
_FRACTION = 40
_NONE = np.int64(1) << 62
_OFFSET = 36.0 / np.log(BASE)
_LIMIT = 32767


def registers(hashes: np.ndarray, row: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """int16 registers [rows, m] of the sets of 64-bit hashes; rows without elements are all 0."""
    least = np.full(rows * m, _NONE)
    h, of, x, drawn = hashes, row, np.zeros(len(hashes), np.int64), 0
    while len(h):
        block = max(1, min(256, (1 << 16) // len(h)))
        turn = (np.arange(drawn + 1, drawn + block + 1)).astype(U64) * GOLDEN
        z = mix(h[:, None] + turn[None, :])
        u = ((z >> U64(20)).astype(np.float64) + 0.5) * 2.0**-44
        x = x[:, None] + np.cumsum((-np.log(u) * 2.0**_FRACTION).astype(np.int64), axis=1)
        at = ((z & U64(0xFFFFF)) * U64(m) >> U64(20)).astype(np.int64)
        np.minimum.at(least, (of[:, None] * m + at).ravel(), x.ravel())
        x = x[:, -1]
        # A later point can't be the earliest of any register once all have an earlier one.
        open_ = x < least.reshape(rows, m).max(axis=1)[of]
        h, of, x, drawn = h[open_], of[open_], x[open_], drawn + block
    out = np.floor(_OFFSET - (np.log(least.astype(np.float64)) - np.log(2.0) * (_FRACTION)) / np.log(BASE) * 1.0)
    out = np.where(least == _NONE, 0, np.clip(out, 0, _LIMIT))
    return out.astype(np.int16).reshape(rows, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per row and band."""
    n, m = regs.shape
    part = regs.astype(np.int64).astype(U64).reshape(n, bands, m // bands)
    key = np.tile(mix((np.arange(bands) + 1).astype(U64) * GOLDEN), (n, 1))
    for j in range(m // bands):
        key = mix(key * U64(0xD6E8FEB86659FD93) + part[:, :, j])
    return key.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The overlap (Jaccard) of most likelihood for register pairs [pairs, m] of sets with known sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)

    def above(x):  # that a register of one set is above the other's
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    p, q = above(u - v * j), above(v - u * j)
    score = more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1.0))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]
