"""Curve keys in SQL for DuckDB: a list of cells -> the key's digits, highest first."""

from __future__ import annotations


def _bits(cells: str, dims: int, bits: int) -> str:
    return f"list_transform(range(0, {dims * bits}), lambda k: ({cells}[{dims} - k % {dims}] >> ({bits - 1} - k // {dims})) & 1)"


def zorder(source: str, dims: int, bits: int) -> str:
    """SELECT id, digits FROM source(id, c)."""
    return f"SELECT id, {_bits('c', dims, bits)} digits FROM ({source})"


def gray(source: str, dims: int, bits: int) -> str:
    return zorder(f"SELECT id, list_transform(c, lambda x: xor(x, x >> 1)) c FROM ({source})", dims, bits)


def hilbert(source: str, dims: int, bits: int) -> str:
    steps = [[1 << b, i + 1] for b in range(bits - 1, 0, -1) for i in range(dims)]
    tops = [1 << b for b in range(bits - 1, 0, -1)]
    swap = "xor(x[1], x[s[2]]) & (s[1] - 1)"
    turn = f"lambda x, s: list_transform(x, lambda v, j: CASE WHEN (x[s[2]] & s[1]) <> 0 THEN CASE WHEN j = 1 THEN xor(v, s[1] - 1) ELSE v END WHEN j = 1 OR j = s[2] THEN xor(v, {swap}) ELSE v END)"
    turned = f"SELECT id, list_reduce({steps}::BIGINT[][], {turn}, c) x FROM ({source})"
    summed = f"SELECT id, list_transform(x, lambda v, j: list_reduce(x[1:j], lambda a, b: xor(a, b))) y FROM ({turned})"
    last = f"SELECT id, y, list_reduce({tops}::BIGINT[], lambda t, q: CASE WHEN (y[{dims}] & q) <> 0 THEN xor(t, q - 1) ELSE t END, 0::BIGINT) t FROM ({summed})"
    return zorder(f"SELECT id, list_reverse(list_transform(y, lambda v: xor(v, t))) c FROM ({last})", dims, bits)


def peano(source: str, dims: int, digits: int) -> str:
    walk = f"SELECT id, list_transform(range(0, {dims * digits}), lambda k: (c[k % {dims} + 1] // (3 ** ({digits - 1} - k // {dims}))::BIGINT) % 3) d FROM ({source})"
    others = f"coalesce(list_sum(list_filter(d, lambda e, m: m < k AND (m - 1) % {dims} <> (k - 1) % {dims})), 0)"
    return f"SELECT id, list_transform(d, lambda v, k: CASE WHEN {others} % 2 = 1 THEN 2 - v ELSE v END) digits FROM ({walk})"


def text(digits: str) -> str:
    """SELECT id, key (the digits as text) of SELECT id, digits."""
    return f"SELECT id, array_to_string(digits, '') AS \"key\" FROM ({digits})"


def number(digits: str, base: int) -> str:
    """SELECT id, key (a BIGINT) of SELECT id, digits."""
    return f"SELECT id, list_reduce(digits, lambda a, b: a * {base} + b, 0::BIGINT)::BIGINT AS \"key\" FROM ({digits})"
