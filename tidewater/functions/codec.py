"""Lossless XOR packing of float vectors against their predecessor in a block."""

from __future__ import annotations

import numpy as np


def pack(rows: np.ndarray, restart: int = 16) -> bytes:
    """float32 rows -> bytes: each word XORed with the row before (none at a restart), leading zero bytes dropped."""
    words = np.ascontiguousarray(rows, dtype=">f4").view(">u4").astype(np.uint32)
    before = np.vstack([np.zeros((1, words.shape[1]), np.uint32), words[:-1]]) if len(words) else words
    before[::restart] = 0
    x = (words ^ before).ravel()
    size = np.where(x >= 1 << 24, 4, np.where(x >= 1 << 16, 3, np.where(x >= 1 << 8, 2, np.where(x > 0, 1, 0)))).astype(np.uint8)
    raw = x.astype(">u4").view(np.uint8).reshape(-1, 4)
    keep = np.arange(4)[None, :] >= 4 - size[:, None]
    return size.tobytes() + raw[keep].tobytes()


def unpack(data: bytes, n: int, dim: int, restart: int = 16) -> np.ndarray:
    size = np.frombuffer(data, np.uint8, n * dim)
    raw = np.zeros((n * dim, 4), np.uint8)
    raw[np.arange(4)[None, :] >= 4 - size[:, None].astype(int)] = np.frombuffer(data, np.uint8, offset=n * dim)
    x = raw.view(">u4").astype(np.uint32).reshape(n, dim)
    for at in range(0, n, restart):
        np.bitwise_xor.accumulate(x[at : at + restart], axis=0, out=x[at : at + restart])
    return x.astype(">u4").view(">f4").astype(np.float32).reshape(n, dim)
