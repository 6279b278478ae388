"""Draws by a hash that every engine has: the same number for the same key, here and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, n: int | None = None) -> Column:
    """The first 32 bits of the md5 of a key's text, modulo n if given."""
    whole = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return whole if n is None else F.pmod(whole, F.lit(n))


def draw_sql(key: str, n: int | None = None) -> str:
    """draw() for DuckDB."""
    whole = f"('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT"
    return whole if n is None else f"({whole} % {n})"
