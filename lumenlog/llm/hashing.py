"""Vectorised hashing: byte windows by a polynomial modulo 2^64 (equal windows have equal hashes, which is all that is asked), words by mixing."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _splitmix(n: int) -> np.ndarray:
    out, x = [], 0x2545F4914F6CDD1D
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ z >> 31)
    return np.array(out, dtype=_U)


_LETTER = _splitmix(256)
_TILE = 1 << 15
_POWER = np.cumprod(np.concatenate([[1], np.full(_TILE * 2, _BASE, dtype=object)]).astype(_U), dtype=_U)
_INVERSE = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_TILE * 2, pow(_BASE, -1, 1 << 64), dtype=_U)]), dtype=_U)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def window_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte window of the uint8 array ``a``; k is at most a tile."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    for at in range(0, n, _TILE):
        to = min(n, at + _TILE)
        x = a[at : to + k - 1]
        h = np.empty(len(x) + 1, _U)
        h[0] = 0
        np.cumsum(_LETTER[x] * _POWER[: len(x)], out=h[1:])
        out[at:to] = mix64((h[k:] - h[:-k]) * _INVERSE[: to - at])
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    out = np.empty(n, h.dtype)
    for at in range(0, n, _TILE):
        to = min(n, at + _TILE)
        m, have = h[at : to + w - 1], 1
        while have * 2 <= w:
            m, have = np.minimum(m[:-have], m[have:]), have * 2
        rest = w - have
        out[at:to] = np.minimum(m[: len(m) - rest], m[rest:])
    return out


def word_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 9 to 13."""
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Spans longer than this are hashed one by one.
_LONG = 1024
_LOW = np.array([(1 << 8 * k) - 1 if k < 8 else _MASK for k in range(9)], dtype=_U)


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span a[start:end], the same for the same bytes wherever they stand.

    Spans are taken eight bytes at a time, all spans at once; each step mixes, so that there is no
    structure by which different spans would collide other than by chance.
    """
    size = ends - starts
    out = mix64(size.astype(_U) + _U(_BASE))
    if not len(starts):
        return out
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([a, np.zeros(8, np.uint8)]), 8)
    long = np.flatnonzero(size > _LONG)
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(memoryview(a[starts[k] : ends[k]]))
    live, at = np.flatnonzero(size <= _LONG), 0
    live = live[size[live] > 0]
    while len(live):
        left = size[live] - at
        lane = np.ascontiguousarray(lanes[starts[live] + at]).view(_U).ravel() & _LOW[np.minimum(left, 8)]
        out[live] = mix64((out[live] ^ lane) * _U(0xD6E8FEB86659FD93))
        at += 8
        live = live[left > 8]
    return mix64(out)
