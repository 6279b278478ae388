"""Functions against plain Python."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import codec, curves, distance, lsh


def test_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist(), (rng.normal(size=5) * 3).tolist()) for i in range(20)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", distance.l2_squared(a, b).alias("l"), distance.inner_product(a, b).alias("p"), distance.cosine(a, b).alias("c")).orderBy("i").collect()
    for (_, x, y), r in zip(rows, got):
        x, y = np.array(x), np.array(y)
        assert r["l"] == pytest.approx(((x - y) ** 2).sum())
        assert r["p"] == pytest.approx(1 - x @ y)
        assert r["c"] == pytest.approx(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    zero = spark.createDataFrame([([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>").select(distance.cosine(a, b).alias("c"), distance.l2_squared(a, b).alias("l")).collect()
    assert zero[0]["c"] is None and zero[1]["l"] is None


def interleave(c: list[int], bits: int) -> int:
    out = 0
    for i in range(bits):
        for j, x in enumerate(c):
            out |= ((x >> i) & 1) << (len(c) * i + j)
    return out


def hilbert_index(cells: list[int], bits: int) -> int:
    """Distance along the Hilbert curve, by the published transposition method."""
    x = list(cells)
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return interleave(x[::-1], bits)


def peano_index(cells: list[int], digits: int) -> int:
    """Distance along the Peano curve of base-3 cells.

    A digit is turned round (2 - digit) when the digits that come before it, in all other
    components, have an odd sum. All components take part.
    """
    n, out = len(cells), 0
    seen = [0] * n
    for level in range(digits - 1, -1, -1):
        for j in range(n):
            digit = (cells[j] // 3**level) % 3
            odd = (sum(seen) - seen[j]) & 1
            out = out * 3 + (2 - digit if odd else digit)
            seen[j] += digit
    return out


INDEX = {"hilbert": hilbert_index, "peano": peano_index, "zorder": interleave, "gray": lambda c, b: interleave([x ^ (x >> 1) for x in c], b)}


@pytest.mark.parametrize("curve,side", [("hilbert", 8), ("peano", 9), ("zorder", 8), ("gray", 8)])
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_curves_visit_every_cell_once(spark, curve, side, dims):
    digits = {8: 3, 9: 2}[side]
    cells = list(itertools.product(range(side), repeat=dims))
    got = spark.createDataFrame([(list(c),) for c in cells], "c array<long>").select("c", curves.key(curve, F.col("c"), dims, digits).alias("k")).collect()
    seen = {r["k"]: r["c"] for r in got}
    assert sorted(seen) == list(range(side**dims)) and all(r["k"] == INDEX[curve](list(r["c"]), digits) for r in got)
    if curve in ("hilbert", "peano"):
        for k in range(side**dims - 1):
            assert sum(abs(a - b) for a, b in zip(seen[k], seen[k + 1])) == 1


@pytest.mark.parametrize("curve", curves.CURVES)
def test_wide_keys(spark, curve):
    """Keys of 40 components are their digits as bytes; a null cell has none."""
    r = np.random.default_rng(5)
    cells = r.integers(0, 9 if curve == "peano" else 16, size=(20, 40)).tolist()
    bits, base = (2, 3) if curve == "peano" else (4, 2)
    got = spark.createDataFrame([(c,) for c in [*cells, None]], "c array<long>").select(curves.key(curve, F.col("c"), 40, bits).alias("k")).collect()
    assert [int(bytes(x["k"]).decode(), base) for x in got[:-1]] == [INDEX[curve](c, bits) for c in cells] and got[-1]["k"] is None
    with pytest.raises(NotImplementedError):
        curves.sierpinski(F.col("c"), 3, 4)


def test_quantize_clamps(spark):
    r = spark.range(1).select(curves.quantize(F.array(*[F.lit(x) for x in (-9.0, 0.0, 0.5, 1.0, 9.0)]), 0.0, 1.0, 4).alias("c")).first()["c"]
    assert r == [0, 0, 8, 15, 15]


def test_bucket_wraps_like_32_bits(spark):
    values = [[2**31 - 1, 12345], [-(2**31), -7], [3, -4]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "h array<long>").select(lsh.bucket(F.col("h"), 10)).collect()]
    for v, g in zip(values, got):
        s = 1
        for x in v:
            s = (s * 31 + x + 2**31) % 2**32 - 2**31
        assert g == s % 10


def test_near_hashes(spark):
    got = spark.createDataFrame([([5, 9],)], "h array<long>").select(lsh.near_hashes(F.col("h"), 2, 1)).first()[0]
    assert sorted(map(tuple, got)) == sorted((5 + a, 9 + b) for a in (-1, 0, 1) for b in (-1, 0, 1))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False), min_size=3, max_size=3), min_size=1, max_size=40))
def test_codec_round_trip(rows):
    x = np.array(rows, np.float32)
    assert (codec.unpack(codec.pack(x), *x.shape).view(np.uint32) == x.view(np.uint32)).all()
