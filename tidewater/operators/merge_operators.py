"""Merge operators as aggregates over a key's operands in order of sequence, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(v: str, seq: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(v).alias("v")))), lambda x: x["v"])


def uint64_add(v: str, seq: str) -> Column:
    """Sum modulo 2**64, as DECIMAL(20, 0); the running sum is exact, so ANSI overflow cannot occur."""
    return F.pmod(F.sum(F.col(v).cast("decimal(20,0)")), F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def greatest(v: str, seq: str) -> Column:
    return F.max(v)


def string_append(v: str, seq: str, delimiter: str = ",") -> Column:
    return F.array_join(_in_order(v, seq), delimiter)


def sort_list(v: str, seq: str) -> Column:
    """Sorted integer lists merged, repeats kept."""
    return F.array_sort(F.flatten(F.collect_list(v)))


def bytes_xor(v: str, seq: str) -> Column:
    return F.bit_xor(v)


def put(v: str, seq: str) -> Column:
    return F.max_by(v, seq)


def operands(v: str, seq: str) -> Column:
    return _in_order(v, seq)


REGISTRY: dict[str, Callable[..., Column]] = {"uint64add": uint64_add, "max": greatest, "stringappend": string_append, "sortlist": sort_list, "bytesxor": bytes_xor, "put": put}


def merge(log: DataFrame, operator: str, key: str = "k", v: str = "v", seq: str = "seq", op: str | None = None) -> DataFrame:
    """(key, v): each key's operands folded by a registered operator.

    With `op`, only what follows the key's last DEL counts, and a PUT starts anew.
    """
    rows = log
    if op:
        by = Window.partitionBy(key)
        reset = F.max(F.when(F.col(op) == "DEL", F.col(seq) + 1).when(F.col(op) == "PUT", F.col(seq))).over(by)
        rows = rows.withColumn("_from", F.coalesce(reset, F.col(seq))).where((F.col(seq) >= F.col("_from")) & (F.col(op) != "DEL"))
    return rows.groupBy(key).agg(REGISTRY[operator](v, seq).alias(v))


def switching(log: DataFrame, functions: tuple[str, ...] = ("sum", "max", "last"), key: str = "k", func: str = "func", v: str = "v", seq: str = "seq") -> DataFrame:
    """(key, func, v, packed) of operands that each name an aggregate function.

    Operands go by sequence. Those without a name before the first named one join it. When the name
    changes, what the old function made of its list becomes the first element of the new list; no
    name after a name is a change too. A key that ever runs under a name that is not in `functions`,
    or under none, cannot be folded: its func is "error" and packed holds all its operands in order.
    """
    known = [x for x in ("sum", "max", "min", "last") if x in functions]
    ops = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(func).alias("f"), F.col(v).alias("v"))))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(None).cast("string").alias("f"), F.lit(False).alias("bad"), none.alias("sum"), none.alias("max"), none.alias("min"), none.alias("last"))

    def result(s: Column) -> Column:
        out = none
        for name in known:
            out = F.when(s["f"] == name, s[name]).otherwise(out)
        return out

    unknown = lambda s: ~F.coalesce(s["f"].isin(known), F.lit(False))

    def step(s: Column, x: Column) -> Column:
        value = x["v"].cast("double")
        name = F.when(s["f"].isNull(), x["f"]).otherwise(F.coalesce(x["f"], F.lit("")))
        switch = s["f"].isNotNull() & (name != s["f"])
        first, base = s["last"].isNull(), result(s)
        grow = lambda part, join: F.when(first, value).when(switch, join(base, value)).otherwise(join(s[part], value))
        return F.struct(name.alias("f"), (s["bad"] | (switch & unknown(s))).alias("bad"), grow("sum", lambda a, b: a + b).alias("sum"), grow("max", F.greatest).alias("max"), grow("min", F.least).alias("min"), value.alias("last"))

    folded = log.groupBy(key).agg(ops.alias("o")).select(key, "o", F.aggregate("o", start, step).alias("s"))
    bad = F.col("s.bad") | unknown(F.col("s"))
    return folded.select(key, F.when(bad, "error").otherwise(F.col("s.f")).alias("func"), F.when(~bad, result(F.col("s"))).alias(v), F.when(bad, F.transform("o", lambda x: x["v"])).alias("packed"))
