"""Numpy helpers on the bytes of one text. Words are runs without the six ASCII white-space bytes."""
from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() cuts at exactly 0x09-0x0D and 0x20."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Full-avalanche mixing of 64-bit values."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (base odd)."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(4096, 1 << max(n - 1, 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inv, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 20:
            _powers[base] = got
    return got[0][:n], got[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Position-free polynomial hash of values[start:end] for each span, mixed with its length."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    return span_hashes(joined + np.uint64(1), starts, ends, BYTE_BASE)


def window_hashes(word_hash: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every window of ``size`` consecutive words."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(word_hash, at, at + size, base)


def covered(hits: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions below n that lie in a window of ``size`` starting at one of ``hits``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, hits, 1)
    np.add.at(d, np.minimum(hits + size, n), -1)
    return np.cumsum(d[:n]) > 0
