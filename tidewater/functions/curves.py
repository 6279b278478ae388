"""Grid cells and space-filling curve keys, all as column expressions.

A key is the list of its digits, highest first: bits, or base-3 digits for the Peano curve. Keys below
2**62 are BIGINT; wider ones are BINARY of a fixed width, a byte for each digit, which sorts as the
number does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURVES = ("zorder", "gray", "hilbert", "peano")


def quantize(v: Column, low: float, high: float, bits: int) -> Column:
    """Cell of each component: its place in [low, high], clamped, in 2**bits steps."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") - F.lit(low)) / F.lit(high - low)))
    return F.transform(v, lambda x: F.least(F.floor(share(x) * F.lit(float(2**bits))), F.lit(2**bits - 1)).cast("bigint"))


def gray_cells(cells: Column) -> Column:
    return F.transform(cells, lambda x: x.bitwiseXOR(F.shiftright(x, 1)))


def _interleaved(cells: Column, dims: int, bits: int) -> Column:
    """The bits of all components, highest first, the last component first within each."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reversed(range(bits)) for j in reversed(range(dims))])
    one = F.lit(1).cast("bigint")
    return F.transform(F.array(cells), lambda c: F.transform(places, lambda p: F.call_function("shiftright", c[p["j"]].cast("bigint"), p["i"]).bitwiseAND(one)))[0]


def _hilbert_cells(cells: Column, dims: int, bits: int) -> Column:
    """Components whose interleaved bits are the distance along the Hilbert curve (the published transposition method)."""
    steps = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])
    zero = F.lit(0).cast("bigint")

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        swap = x[0].bitwiseXOR(x[s["i"]]).bitwiseAND(low)
        flip = x[s["i"]].bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    start = F.transform(cells, lambda v: v.cast("bigint"))
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    summed = lambda x: F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), zero, lambda a, b: a.bitwiseXOR(b)))
    tops = F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def ended(x: Column) -> Column:
        last = F.aggregate(tops, zero, lambda t, q: F.when(x[dims - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(F.array(last), lambda t: F.reverse(F.transform(x, lambda v: v.bitwiseXOR(t))))[0]

    once = lambda value, body: F.transform(F.array(value), body)[0]
    return once(once(turned, summed), ended)


def _peano_digits(cells: Column, dims: int, digits: int) -> Column:
    """Base-3 digits of the distance along the Peano curve.

    A digit is turned round (2 - digit) when the digits that come before it, in all other
    components, have an odd sum. All components take part.
    """
    places = F.array(*[F.struct(F.lit(3**level).cast("bigint").alias("p"), F.lit(j).alias("j")) for level in reversed(range(digits)) for j in range(dims)])
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), dims).alias("seen"), F.lit(0).cast("bigint").alias("all"), F.array().cast("array<bigint>").alias("out"))

    def walked(c: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            digit = F.pmod(F.floor(c[x["j"]] / x["p"]).cast("bigint"), F.lit(3).cast("bigint"))
            odd = F.pmod(s["all"] - s["seen"][x["j"]], F.lit(2)) == 1
            seen = F.transform(s["seen"], lambda v, j: F.when(j == x["j"], v + digit).otherwise(v))
            return F.struct(seen.alias("seen"), (s["all"] + digit).alias("all"), F.array_append(s["out"], F.when(odd, 2 - digit).otherwise(digit)).alias("out"))

        return F.aggregate(places, start, step)["out"]

    return F.transform(F.array(cells), walked)[0]


def digits_of(curve: str, cells: Column, dims: int, bits: int) -> Column:
    """The key's digits, highest first (bits: base-3 digits of a component for the Peano curve)."""
    if curve == "peano":
        return _peano_digits(cells, dims, bits)
    if curve not in CURVES:
        raise ValueError(curve)
    shaped = {"zorder": lambda c: c, "gray": gray_cells, "hilbert": lambda c: _hilbert_cells(c, dims, bits)}[curve](cells)
    return _interleaved(shaped, dims, bits)


def key(curve: str, cells: Column, dims: int, bits: int) -> Column:
    """The key of a cell: BIGINT where it fits below 2**62, else BINARY with a byte for each digit. Null for null cells."""
    base = 3 if curve == "peano" else 2
    digits = digits_of(curve, cells, dims, bits)
    if base ** (dims * bits) <= 1 << 62:
        return F.when(cells.isNotNull(), F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, x: s * base + x))
    return F.when(cells.isNotNull(), F.array_join(F.transform(digits, lambda x: x.cast("string")), "").cast("binary"))


def zorder(cells: Column, dims: int, bits: int) -> Column:
    """Bit i of component j is bit dims * i + j of the key."""
    return key("zorder", cells, dims, bits)


def gray(cells: Column, dims: int, bits: int) -> Column:
    return key("gray", cells, dims, bits)


def hilbert(cells: Column, dims: int, bits: int) -> Column:
    return key("hilbert", cells, dims, bits)


def peano(cells: Column, dims: int, digits: int) -> Column:
    return key("peano", cells, dims, digits)


def sierpinski(*_: object) -> Column:
    raise NotImplementedError("the Sierpinski curve is a name without an implementation")
