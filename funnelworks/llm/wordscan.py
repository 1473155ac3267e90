"""Words of many texts at once: where they are and a 64-bit hash of each, with numpy over raw bytes.

A word's hash is a polynomial of random byte values with an odd base modulo 2**64, taken from one
running sum over all bytes, then mixed. Distinct words share a hash with a chance of some 2**-60 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


_tables: dict[int, np.ndarray] = {}  # of each base the longest one so far


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of one of the two bases."""
    table = _tables.get(base, np.ones(1, np.uint64))
    if n > len(table):
        bits = max(16, (n - 1).bit_length())
        table = np.ones(1 << bits, np.uint64)
        for k in range(bits):  # doubles the known part
            table[1 << k:2 << k] = table[:1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running polynomial sums S, one longer than ``data``; bytes a..b hash to (S[b] - S[a]) * base**-a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * powers(_INVERSE, len(sums))[start])


class Words(NamedTuple):
    data: bytes
    start: np.ndarray  # of each word in ``data``
    stop: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # text k has words bounds[k]:bounds[k + 1]
    joints: np.ndarray  # text k has bytes joints[k]:joints[k + 1] - 1


def scan(texts: list[bytes], fold: bool = False) -> Words:
    """``fold``: A-Z hash as a-z. Words are what lies between the white space \\x20 \\x09-\\x0D."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]  # the last byte is white space
    joints = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    bounds = np.searchsorted(start, joints)
    return Words(joined, start, stop, span_hashes(prefix_sums(data, fold), start, stop), bounds, joints)


def gather(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start[k], start[k] + 1, ... ``many[k]`` of them, for all k one after the other."""
    stop = np.cumsum(many)
    return np.repeat(start - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)
