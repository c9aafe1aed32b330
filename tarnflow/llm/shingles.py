"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from .common import kept

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)
#: Powers that a process keeps; longer runs of them are made for one call.
_KEEP = 1 << 21


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1) modulo 2^64, or those of the inverse of B."""
    tables = kept("powers", dict)
    have = tables.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _BINV if inverse else _B, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= _KEEP:
            tables[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[k] = sum of (data[j] + 1) * B^j for j < k, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    Words are runs of bytes other than space and 9 to 13, A-Z lower-cased. A text of fewer
    words has its whole sequence as one shingle; one without words has the empty set.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    first, last = edge[::2], edge[1::2]
    P = prefix_sums(data)
    w = mix((P[last] - P[first]) * powers(len(data) + 1, True)[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], np.searchsorted(first, ends)])
    grams = np.zeros(len(w), dtype=np.uint64)
    if len(w) >= words:
        n = len(w) - words + 1
        h = w[:n].copy()
        for k in range(1, words):
            h = h * _B + w[k : k + n]
        grams[:n] = mix(h)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            h = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x in w[lo:hi]:
                    h = h * _B + x
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def blocks(ids, texts, size: int = 1_000_000):
    """(ids, texts) in blocks of about `size` bytes of text; null texts as empty ones."""
    a, b, held = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t.as_py() or b""
        a.append(i)
        b.append(t)
        held += len(t)
        if held >= size:
            yield a, b
            a, b, held = [], [], 0
    if a:
        yield a, b
