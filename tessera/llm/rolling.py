"""Polynomial hashes of substrings by running sums, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _table() -> np.ndarray:
    x, out = 0x243F6A8885A308D3, []
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _M
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


BYTES = _table()


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        base, inv = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, base, np.uint64))), dtype=np.uint64)
            _inv = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, inv, np.uint64))), dtype=np.uint64)


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums, one longer than the data: of a uint8 array, or of uint64 codes as they are."""
    _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTES[data] if data.dtype == np.uint8 else data) * _pow[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(total: np.ndarray, start, stop) -> np.ndarray:
    """Hashes of data[start:stop] for arrays or slices of starts and stops."""
    return mixed((total[stop] - total[start]) * _inv[: len(total)][start])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by running minima inside blocks."""
    n = len(keys)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
