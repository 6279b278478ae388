"""p-stable hashing, its buckets and neighbouring buckets, and SAX words."""

from __future__ import annotations

import itertools
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.distance import dot

SEED = 66


@lru_cache(maxsize=None)
def _drawn(family: int, k: int, dim: int) -> tuple[tuple[float, ...], float]:
    r = np.random.Generator(np.random.PCG64([SEED, family, k, dim]))
    return tuple(round(float(x), 6) for x in r.standard_normal(dim)), round(float(r.uniform()), 6)


def coefficients(family: int, k: int, dim: int) -> list[float]:
    """Direction of hash k of a family: seeded draws of the standard normal distribution, to six digits."""
    return list(_drawn(family, k, dim)[0])


def offset(family: int, k: int, dim: int, width: float) -> float:
    """A seeded draw from [0, width)."""
    return _drawn(family, k, dim)[1] * width


def hashes(v: Column, family: int, k: int, dim: int, width: float) -> Column:
    """floor((a . v + b) / width) for each of a family's k directions."""
    one = lambda j: F.floor((dot(v, F.array(*[F.lit(c) for c in coefficients(family, j, dim)])) + F.lit(offset(family, j, dim, width))) / F.lit(width))
    return F.array(*[one(j) for j in range(k)])


def bucket(h: Column, n: int) -> Column:
    """The polynomial 31 * r + x from 1 over the hashes, in wrapping 32 bits, modulo n (never negative)."""
    wrapped = F.aggregate(h, F.lit(1).cast("bigint"), lambda s, x: F.pmod(s * 31 + x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31))
    return F.pmod(wrapped, F.lit(n)).cast("int")


def near_hashes(h: Column, k: int, reach: int) -> Column:
    """All hashes within `reach` of each component, (2 * reach + 1)**k of them."""
    steps = [F.zip_with(h, F.array(*[F.lit(d) for d in delta]), lambda x, d: x + d) for delta in itertools.product(range(-reach, reach + 1), repeat=k)]
    return F.array(*steps)


def cuts(bits: int) -> list[float]:
    """The inner quantiles that cut the normal distribution into 2**bits equal parts, to six digits."""
    return [round(NormalDist().inv_cdf(i / 2**bits), 6) for i in range(1, 2**bits)]


def sax_letters(v: Column, dim: int, segments: int, bits: int) -> Column:
    """z-normalised segment means, each as the number of cuts below it."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / dim
    power = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / dim
    deviation = F.nullif(F.sqrt(F.greatest(power - mean * mean, F.lit(0.0))), F.lit(0.0))
    step = dim // segments
    means = [F.aggregate(F.slice(v, j * step + 1, step), F.lit(0.0), lambda s, x: s + x.cast("double")) / step for j in range(segments)]
    return F.array(*[sum((F.when((m - mean) / deviation > c, 1).otherwise(0) for c in cuts(bits)), F.lit(0)) for m in means])


def sax_word(v: Column, dim: int, segments: int, bits: int) -> Column:
    """The letters side by side, first letter highest, as one Gray-coded number."""
    letters = sax_letters(v, dim, segments, bits)
    whole = F.aggregate(letters, F.lit(0).cast("bigint"), lambda s, x: s * 2**bits + x)
    return whole.bitwiseXOR(F.shiftright(whole, 1))
