"""Access-log analytics: access(ts, op, key, size[, file]) rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.draws import draw
from tidewater.session import Scratch


def by_type(log: DataFrame, op: str, key: str) -> DataFrame:
    return log.groupBy(op).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"))


def per_second(log: DataFrame, op: str, ts: str, seconds: int = 1) -> DataFrame:
    """(op, start, n): accesses of each slot of time."""
    start = (F.floor(F.unix_seconds(F.col(ts)) / seconds) * seconds).alias("start")
    return log.groupBy(op, start).agg(F.count("*").alias("n"))


def top_keys(log: DataFrame, op: str, key: str, most: int) -> DataFrame:
    c = log.groupBy(op, key).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(op).orderBy(F.desc("n"), key))).where(F.col("rank") <= most)


def count_histogram(log: DataFrame, key: str) -> DataFrame:
    """(accesses, n_keys): how many keys were accessed how often."""
    return log.groupBy(key).agg(F.count("*").alias("accesses")).groupBy("accesses").agg(F.count("*").alias("n_keys"))


def size_histogram(log: DataFrame, size: Column, step: int) -> DataFrame:
    return log.select((F.floor(size / step) * step).alias("low")).groupBy("low").agg(F.count("*").alias("n"))


def reuse_interval(log: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, least, mean, most): accesses of all keys between two accesses of the same key, by the order number."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("gap", gap).where("gap is not null").groupBy(key).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.avg("gap").alias("mean"), F.max("gap").alias("most"))


def co_access(log: DataFrame, op: str, key: str) -> DataFrame:
    """(a, b, r): correlation of two access types' counts over all keys.

    From sums: a key that lacks a type counts as zero and adds nothing, so only pairs that occur are
    joined, by key. The tables of types have a row for each record type.
    """
    c = log.groupBy(F.col(key).alias("key"), F.col(op).alias("op")).agg(F.count("*").cast("double").alias("n"))
    n = F.lit(log.select(key).distinct().count()).cast("double")
    one = c.groupBy("op").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    a, b = (one.toDF(x, f"s{x}", f"q{x}") for x in ("a", "b"))
    ca, cb = (c.toDF("key", x, f"n{x}") for x in ("a", "b"))
    both = ca.join(cb, "key").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    spread = F.sqrt((n * F.col("qa") - F.col("sa") * F.col("sa")) * (n * F.col("qb") - F.col("sb") * F.col("sb")))
    return pairs.select("a", "b", ((n * F.coalesce("ab", F.lit(0.0)) - F.col("sa") * F.col("sb")) / F.nullif(spread, F.lit(0.0))).alias("r"))


def temperature(accesses: DataFrame, file: str = "file", step: str = "step", hits: str = "hits", lookups: str = "lookups", similarity: str = "similarity", rate: float = 0.9) -> DataFrame:
    """(file, access_score, hit_score, similarity_score, temperature): scores that fade with the steps between records.

    At each record a score becomes s * e**(-rate * gap) + x * (1 - e**(-rate * gap)), where the gap is
    the steps since the record before (1 for the first). Written out, a record counts by its own
    share times e**(-rate * steps to the last record), so a file's scores are plain sums. Age is the
    steps from the file's last record to the last of all; the temperature is
    100 * access + 100 * hit + 0.1 * similarity + 0.1 * age.
    """
    mine = Window.partitionBy(file)
    gap = F.coalesce(F.col(step) - F.lag(step).over(mine.orderBy(step)), F.lit(1))
    known = accesses.withColumns({"_gap": gap, "_last": F.max(step).over(mine)})
    weight = F.exp(-rate * (F.col("_last") - F.col(step))) * (1 - F.exp(-rate * F.col("_gap")))
    score = lambda c, name: F.sum(F.col(c) * weight).alias(name)
    s = known.groupBy(file).agg(score(lookups, "access_score"), score(hits, "hit_score"), score(similarity, "similarity_score"), F.max("_last").alias("_last"))
    newest = accesses.agg(F.max(step)).first()[0]
    heat = 100 * F.col("access_score") + 100 * F.col("hit_score") + 0.1 * F.col("similarity_score") + 0.1 * (F.lit(newest) - F.col("_last"))
    return s.select(file, "access_score", "hit_score", "similarity_score", heat.alias("temperature"))


def _at_most_before(x: np.ndarray) -> np.ndarray:
    """For each place the number of earlier places whose value is not greater, by merging sorted blocks of doubling size."""
    n = len(x)
    out, order, size = np.zeros(n, np.int64), np.arange(n), 1
    while size < n:
        block = np.arange(n) // (2 * size)
        late = (np.arange(n) // size) % 2 == 1
        # order holds each block of `size` sorted by (value, place); sort pairs of blocks, earlier places first among equals
        by = np.lexsort((order, x[order], block))
        order = order[by]
        second = late[order]  # whether a place lies in the later half of its pair
        firsts = np.cumsum(~second)
        start = np.searchsorted(block, block)  # block is by place, and places of a pair stand together
        before = np.concatenate(([0], firsts))[start]
        out[order[second]] += (firsts - before)[second]
        size *= 2
    return out


def stack_distance(log: DataFrame, shards: int, key: str, order: str) -> DataFrame:
    """(key, order, shard, distance): distinct keys of the shard accessed since the key's last access; -1 at its first.

    Accesses between two of one key that repeat a key within the stretch are not counted; what is left
    follows from how many earlier accesses have a last access no later, which merging sorted blocks
    counts for all at once. A shard is one task's work: give so many that one fits (40 bytes a row).
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        place = np.arange(len(pdf))
        last = pdf.assign(at=place).groupby(key)["at"].shift(1).fillna(-1).to_numpy().astype(np.int64)
        distance = np.where(last < 0, -1, _at_most_before(last) - (last + 1))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "shard": pdf["shard"], "distance": distance})

    kinds = dict(log.dtypes)
    return log.select(key, order, draw(F.col(key), shards).cast("int").alias("shard")).groupBy("shard").applyInPandas(count, f"{key} {kinds[key]}, {order} {kinds[order]}, shard int, distance long")


def miss_ratio(log: DataFrame, shards: int, capacities: list[int], key: str, order: str) -> DataFrame:
    """(capacity, n, misses, miss_ratio) of LRU caches, one for each key shard with an equal part of the capacity.

    A cache misses a key at its first access and where as many others as it holds came since its last.
    """
    each = stack_distance(log, shards, key, order).withColumn("capacity", F.explode(F.array(*map(F.lit, capacities))))
    miss = (F.col("distance") < 0) | (F.col("distance") >= F.greatest(F.lit(1), F.floor(F.col("capacity") / shards)))
    c = each.groupBy("capacity").agg(F.count("*").alias("n"), F.count_if(miss).alias("misses"))
    return c.withColumn("miss_ratio", F.col("misses") / F.col("n"))


def numbered(rows: DataFrame, order: str, n: str = "n") -> DataFrame:
    """rows with their ordinal from 0: places within range partitions, after the counts of those before."""
    parts = Scratch(rows.sparkSession, "numbered").keep(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()), "parts")  # written, so that its partitions stay
    sums = {r["_p"]: r["c"] for r in parts.groupBy("_p").agg(F.count("*").alias("c")).collect()}  # a row for each partition
    first, at = [], 0
    for p in sorted(sums):
        first.append((p, at))
        at += sums[p]
    base = F.create_map(*[F.lit(x) for pair in first for x in pair])[F.col("_p")] if first else F.lit(0)
    return parts.withColumn(n, F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + base).drop("_p")


def paired(searched: DataFrame, results: DataFrame, on: str = "n") -> DataFrame:
    """Segments searched next to latency and accuracy, by ordinal."""
    return searched.join(results, on)
