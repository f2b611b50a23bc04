"""Vectorised word hashing over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

from ledgerlens.llm._util import U64, mix64

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def separators(text_bytes: bytes) -> np.ndarray:
    """Lookup table over byte values: True for the given separators."""
    out = np.zeros(256, bool)
    out[np.frombuffer(text_bytes, np.uint8)] = True
    return out


def word_bounds(buffer: np.ndarray, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every run of bytes that are no separators."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~is_separator[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buffer[start:end]`` that do not depend on the place."""
    n = len(buffer)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))))
        back = np.cumprod(np.concatenate((one, np.full(n, _INVERSE, np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + U64(1)) * power[:-1])))
        value = (sums[ends] - sums[starts]) * back[starts]
        return mix64(value ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))
