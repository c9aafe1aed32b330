"""Compact columns of sorted integers and of texts, for what has to cross a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_ints(values: np.ndarray) -> bytes:
    """Differences of ascending unsigned integers, their bytes sorted by significance, compressed."""
    d = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def pack_array(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def pack_small(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers that are mostly small: their bytes sorted by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), pack_array(sizes)


def unpack_texts(data: bytes, sizes: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(unpack_array(sizes, np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
