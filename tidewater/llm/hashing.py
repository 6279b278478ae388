"""Numpy kernels on text: word boundaries and 64-bit word hashes without a Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, after A-Z have been
lower-cased; these bytes never occur inside a multi-byte character. A word's hash is a polynomial,
modulo 2**64, of random values of its bytes, then mixed; it comes from running sums over the text.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of multi-byte characters separates plain words.
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = False
PLAIN[128:] = False
#: A random value for each byte, equal for A-Z and a-z, and the base of the polynomial over them.
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, size=256, dtype=np.uint64)[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = _INV = np.empty(0, np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULT = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n; grown on demand, SEGMENT long unless a word is longer."""
    global _POW, _INV
    if len(_POW) <= n:
        steps = np.full((2, n + 1), BASE, np.uint64)
        steps[1] = pow(int(BASE), -1, 2**64)
        steps[:, 0] = 1
        _POW, _INV = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _POW, _INV


def _segment(raw: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.ones(len(raw) + 2, dtype=bool)
    separators.take(raw, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    power, inverse = powers(max(len(raw), 4096))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(TABLE.take(raw) * power[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(text: bytes, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of a text's words; long texts go in segments cut at separators."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= SEGMENT:
        return _segment(raw, separators)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        while end < len(raw):
            gaps = np.flatnonzero(separators[raw[end : end + SEGMENT]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + SEGMENT, len(raw))
        s, e, h = _segment(raw[at:end], separators)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words in order; fewer words count as one run; no words, none."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        total = np.sum(hashes * _MULT[: len(hashes)], keepdims=True) + np.uint64(len(hashes))
        return mix(total)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * _MULT[i]
    return mix(out)
