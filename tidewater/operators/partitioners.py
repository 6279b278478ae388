"""Routing operators: which partitions a mutation or a query goes to, and search within partitions.

Each router gives ARRAY<INT> of distinct partitions. A deletion without a value goes to all. Routed
rows are exploded and then meet by an equality join or cogroup on the partition, so Spark's own
exchange does the routing. The ranges of curve partitioners are one table for mutations and queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import curves, lsh
from tidewater.functions.distance import exact, kernel, l2_squared, slack
from tidewater.functions.draws import draw
from tidewater.session import Scratch


def every(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def simple(key: Column, n: int) -> Column:
    """One partition by a hash of the id; queries go to every()."""
    return F.array(draw(key, n).cast("int"))


def by_lsh(v: Column, n: int, families: int, k: int, dim: int, width: float) -> Column:
    """A bucket of each family."""
    return F.array_distinct(F.array(*[lsh.bucket(lsh.hashes(v, f, k, dim, width), n) for f in range(families)]))


def by_lsh_random(v: Column, key: Column, n: int, families: int, k: int, dim: int, width: float, seed: int = 23456789) -> Column:
    """by_lsh() and n / 3 draws by a seeded hash of the id: for queries."""
    draws = [draw(F.concat_ws(":", F.lit(seed), F.lit(i), key.cast("string")), n).cast("int") for i in range(n // 3)]
    return F.array_distinct(F.concat(by_lsh(v, n, families, k, dim, width), F.array(*draws)))


def by_lsh_near(v: Column, n: int, families: int, k: int, dim: int, width: float, reach: int) -> Column:
    """The buckets of all hashes within reach: for queries."""
    some = [F.transform(lsh.near_hashes(lsh.hashes(v, f, k, dim, width), k, reach), lambda h: lsh.bucket(h, n)) for f in range(families)]
    return F.array_distinct(F.concat(*some))


def heads(keys: DataFrame, n: int, key: str = "key") -> list:
    """The first key of each of n ranges of equal count but the first: exact quantiles of the distinct keys' order."""
    total = keys.count()
    if not total:
        return []
    wanted = sorted({total * i // n for i in range(1, n)})
    ranked = keys.groupBy(key).agg(F.count("*").alias("c"))
    # running counts by range partitions: offsets of the partitions first, so no single task sorts all
    parts = Scratch(keys.sparkSession, "heads").keep(ranked.repartitionByRange(F.col(key)).withColumn("p", F.spark_partition_id()), "parts")  # written, so that its partitions stay
    sums = {r["p"]: r["c"] for r in parts.groupBy("p").agg(F.sum("c").alias("c")).collect()}
    base, at = {}, 0
    for p in sorted(sums):
        base[p], at = at, at + sums[p]
    first = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))])[F.col("p")]
    placed = parts.withColumn("to", F.sum("c").over(Window.partitionBy("p").orderBy(key)) + first)
    hit = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("to") - F.col("c")) & (w < F.col("to"))) if wanted else F.lit(False)
    found = [(r[key], r["to"] - r["c"], r["to"]) for r in placed.where(hit).select(key, "c", "to").collect()]  # n - 1 rows at most
    return sorted({k for w in wanted for k, a, b in found if a <= w < b})


def by_range(key: Column, heads: list) -> Column:
    """The number of heads at or below the key."""
    out = F.lit(0)
    for h in heads:
        out = out + F.when(key >= F.lit(h), 1).otherwise(0)
    return F.array(out.cast("int"))


def with_ring(partitions: Column, n: int, copies: int) -> Column:
    """A central partition and its nearest neighbours around the ring, `copies` in all."""
    steps = [0]
    for d in range(1, n):
        steps += [-d, d]
    return F.array_distinct(F.flatten(F.transform(partitions, lambda p: F.array(*[F.pmod(p + s, F.lit(n)).cast("int") for s in steps[:copies]]))))


def lsh_cells(rows: DataFrame, families: int, k: int, dim: int, width: float, period: Column, *, curve: str = "hilbert", bits: int = 4, v: str = "v") -> DataFrame:
    """rows with `period` and `cells`: for each family the curve key of its k hashes.

    The hashes are a grid cell: shifted to the middle of a grid of 2**bits a side, and clamped to it.
    """
    half = 1 << (bits - 1)
    grid = lambda f: F.transform(lsh.hashes(F.col(v), f, k, dim, width), lambda h: F.greatest(F.lit(0), F.least(F.lit(2 * half - 1), h + half)).cast("bigint"))
    return rows.withColumns({"period": period, "cells": F.array(*[curves.key(curve, grid(f), k, bits) for f in range(families)])})


def lsh_ranges(cells: DataFrame, n: int) -> DataFrame:
    """(family, period, heads): n ranges of equal count over the keys of the period before, a row for each family and period.

    `heads` are the distinct first keys of the ranges after the first, n - 1 at most. Keys are counted
    before anything is ordered, and a grid has 2**(bits * k) of them at most.
    """
    each = cells.select("period", F.posexplode("cells").alias("family", "key"))
    counts = each.groupBy("period", "family", "key").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("period", "family")
    placed = counts.withColumns({"to": F.sum("c").over(whole.orderBy("key")), "all": F.sum("c").over(whole)})
    cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(F.col("all") * i / n))
    first = F.exists(cuts, lambda w: (w >= F.col("to") - F.col("c")) & (w < F.col("to")))
    heads = placed.where(first).groupBy("family", "period").agg(F.array_sort(F.collect_list("key")).alias("heads"))
    return heads.select("family", (F.col("period") + 1).alias("period"), "heads")


def by_lsh_ranges(cells: DataFrame, ranges: DataFrame, families: int, fresh: int) -> DataFrame:
    """cells with `partitions`: of each family the range that holds its key, by the `fresh` newest tables of its period.

    Mutations go by the newest table (fresh = 1); a query asks by as many as could have routed what it
    may see. Before a family's first table its rows are in partition 0. Tables meet rows by an
    equality join on the period.
    """
    marks = cells.select("period").distinct().withColumn("family", F.explode(F.sequence(F.lit(0), F.lit(families - 1))))
    numbered = ranges.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy("period")))  # a row for each period
    known = marks.withColumn("r", F.lit(None).cast("int")).unionByName(numbered.drop("heads"))
    newest = F.max("r").over(Window.partitionBy("family").orderBy("period").rangeBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("to", newest).where("r is null").select("period", "family", F.explode(F.when(F.col("to").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.lit(1), F.col("to") - fresh + 1), F.col("to")))).alias("r"))
    found = known.join(numbered.select("family", "r", "heads"), ["family", "r"], "left")
    tables = found.groupBy("period").agg(F.collect_list(F.struct("family", F.coalesce("heads", F.array()).alias("heads"))).alias("tables"))
    below = lambda x: F.size(F.filter(x["heads"], lambda h: h <= F.element_at("cells", x["family"] + 1)))
    return cells.join(tables, "period", "left").withColumn("partitions", F.array_sort(F.array_distinct(F.transform("tables", below)))).drop("tables")


def fit_centroids(rows: DataFrame, k: int, rounds: int = 10, v: str = "v", key: str = "id") -> list[list[float]]:
    """Centroids of k-means: the rows of least id hash first, then `rounds` Lloyd steps; k vectors reach the driver.

    Assignments are ties by number, means are rounded to nine digits, and an empty cluster keeps its centroid.
    """
    first = rows.where(F.col(v).isNotNull()).orderBy(draw(F.col(key)), key).limit(k).select(F.col(v).cast("array<double>").alias("c")).collect()
    centroids = [list(r["c"]) for r in first]
    for _ in range(rounds if centroids else 0):
        near = by_centroids(rows.where(F.col(v).isNotNull()), centroids, 1, v).select(F.col("partitions")[0].alias("p"), F.posexplode(v).alias("j", "x"))
        means = near.groupBy("p", "j").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("a"))
        new = {r["p"]: list(r["c"]) for r in means.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "a"))), lambda x: x["a"]).alias("c")).collect()}
        moved = [new.get(i, c) for i, c in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def by_centroids(rows: DataFrame, centroids: list[list[float]], copies: int, v: str = "v") -> DataFrame:
    """rows with partitions: the `copies` nearest centroids, nearest first, ties by number."""
    near = [F.struct(l2_squared(F.col(v), F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return rows.withColumn("partitions", F.transform(F.slice(F.array_sort(F.array(*near)), 1, copies), lambda x: x["i"]))


def hot(words: DataFrame, window: Column, most: int) -> DataFrame:
    """(window, word): the `most` commonest words of the window before, ties by word."""
    counts = words.groupBy(window.alias("w"), "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    return ranked.select((F.col("w") + 1).alias("window"), "word", "n")


def odyssey(words: DataFrame, window: Column, groups: int, replicas: int, most: int, key: str = "id", query: bool = False, skew: float | None = None) -> DataFrame:
    """words(key, word) with the group and partitions: hot words by a hash of the id, others by word modulo groups.

    With `skew`, so do the rows of a group that held more than `skew` times the mean of the groups in the
    window before. Mutations go to every replica of the group (replica r of group g is partition r * groups + g), a query to one, by turns.
    """
    listed = hot(words, window, most).select("window", "word", F.lit(True).alias("hot"))
    rows = words.withColumn("window", window).join(listed, ["window", "word"], "left")
    home = F.pmod(F.col("word"), F.lit(groups)).cast("int")
    spread = F.coalesce("hot", F.lit(False))
    if skew is not None:
        counts = words.groupBy((window + 1).alias("window"), home.alias("home")).agg(F.count("*").alias("c"))
        mean = F.sum("c").over(Window.partitionBy("window")) / groups  # `groups` rows of a window
        heavy = counts.withColumn("mean", mean).where(F.col("c") > F.col("mean") * skew).select("window", "home", F.lit(True).alias("heavy"))
        rows = rows.withColumn("home", home).join(heavy, ["window", "home"], "left").drop("home")
        spread = spread | F.coalesce("heavy", F.lit(False))
    rows = rows.withColumn("grp", F.when(spread, draw(F.col(key), groups)).otherwise(home).cast("int"))
    if query:
        turn = F.pmod(F.row_number().over(Window.partitionBy("grp").orderBy(key)) - 1, F.lit(replicas))
        return rows.withColumn("partitions", F.array((turn * groups + F.col("grp")).cast("int")))
    return rows.withColumn("partitions", F.transform(F.sequence(F.lit(0), F.lit(replicas - 1)), lambda r: (r * groups + F.col("grp")).cast("int")))


def routed(rows: DataFrame, partitions: Column, n: int, *, query: bool = False, op: str | None = None, v: str = "v") -> DataFrame:
    """A row for each partition, with partition_id and, for queries, n_sent."""
    to = partitions
    if op:
        if query:
            to = F.when(F.col(op) == "D", F.raise_error(F.lit("a deletion is not a query"))).otherwise(to)
        else:
            to = F.when((F.col(op) == "D") & F.col(v).isNull(), every(n)).otherwise(to)
    out = rows.withColumn("_to", to)
    if query:
        out = out.withColumn("n_sent", F.size("_to"))
    return out.withColumn("partition_id", F.explode("_to")).drop("_to")


def search(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Partial results per (query, partition): query_id, partition_id, n_sent, neighbors ascending by (dist, id).

    rows(partition_id, id, v) and queries(partition_id, query_id, v, n_sent); every routed query
    answers, with an empty list where its partition has no row, so that no merge waits for ever.
    """
    neighbor = "array<struct<dist:double,id:bigint>>"

    def local(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame([], columns=["query_id", "partition_id", "n_sent", "neighbors"], dtype=object)
        out = []
        left = left.drop_duplicates("id").sort_values("id") if len(left) else left
        x = np.stack(left["v"].to_numpy()).astype(np.float64) if len(left) else None
        q = np.stack(right["v"].to_numpy()).astype(np.float64)
        room = slack(metric, q, x) if x is not None else None
        for i in range(0, len(q), 512):
            for j, d in enumerate(kernel(metric, q[i : i + 512], x) if x is not None else [None] * len(q[i : i + 512])):
                if d is None:
                    out.append([])
                    continue
                cut = np.partition(d, k - 1)[k - 1] + room[i + j] if len(d) > k else np.inf
                near = np.flatnonzero(d <= cut)  # all that are tied at the cut
                dist = np.concatenate([exact(metric, np.broadcast_to(q[i + j], (len(c), q.shape[1])), x[c]) for c in np.array_split(near, 1 + len(near) // 32768)])
                dist = np.where(np.isfinite(d[near]), dist, d[near])
                names = left["id"].to_numpy()[near]
                by = np.lexsort((names, dist))[:k]
                top = zip(dist[by].tolist(), names[by].tolist())
                out.append([{"dist": a, "id": b} for a, b in top])
        return pd.DataFrame({"query_id": right["query_id"].to_numpy(), "partition_id": key[0], "n_sent": right["n_sent"].to_numpy(), "neighbors": out})

    left = rows.select("partition_id", F.col("id").cast("bigint").alias("id"), "v").where("v is not null").toDF("partition_id", "id", "v")  # names of their own, should both sides come from one table
    right = queries.select("partition_id", F.col("query_id").cast("bigint").alias("query_id"), "v", "n_sent").toDF("partition_id", "query_id", "v", "n_sent")
    return left.groupBy("partition_id").cogroup(right.groupBy("partition_id")).applyInPandas(local, f"query_id bigint, partition_id int, n_sent int, neighbors {neighbor}")


def merged(partials: DataFrame, k: int) -> DataFrame:
    """(query_id, n_combined, n_to_combine, complete, neighbors): partial lists united, distinct ids, k nearest."""
    flat = partials.select("query_id", F.explode_outer("neighbors").alias("x")).where("x is not null").groupBy("query_id", F.col("x.id").alias("id")).agg(F.min("x.dist").alias("dist"))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dist", "id"))).alias("neighbors"))
    counts = partials.groupBy("query_id").agg(F.count("*").cast("int").alias("n_combined"), F.max("n_sent").alias("n_to_combine"))
    return counts.join(lists, "query_id", "left").select("query_id", "n_combined", "n_to_combine", (F.col("n_combined") == F.col("n_to_combine")).alias("complete"), F.coalesce("neighbors", F.array().cast("array<struct<dist:double,id:bigint>>")).alias("neighbors"))


def ranked(merged_: DataFrame) -> DataFrame:
    """(query_id, rank, id, dist) of merged results."""
    return merged_.select("query_id", F.posexplode("neighbors").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.dist").alias("dist"))


def balance(routed_: DataFrame, window: Column | None = None) -> DataFrame:
    """Partitions, rows, the largest, and (max - mean) / mean: in all, or of each window of records."""
    if window is not None:
        c = routed_.groupBy(window.alias("window"), "partition_id").agg(F.count("*").alias("n")).groupBy("window")
    else:
        c = routed_.groupBy("partition_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("partitions"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"), ((F.max("n") - F.avg("n")) / F.avg("n")).alias("imbalance"))


def flushed(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Rows that an index fed `size` rows at a time has taken in: each partition's last, unfilled buffer is left out."""
    mine = Window.partitionBy("partition_id")
    numbered = rows.withColumns({"_r": F.row_number().over(mine.orderBy(order)), "_c": F.count("*").over(mine)})
    return numbered.where(F.col("_r") <= F.col("_c") - F.col("_c") % size).drop("_r", "_c")


def split(stream: DataFrame, op: str = "op") -> tuple[DataFrame, DataFrame]:
    """Mutations and queries of one table or stream."""
    return stream.where(F.col(op) != "Q"), stream.where(F.col(op) == "Q")


def latency(partials: DataFrame) -> DataFrame:
    """(query_id, n_to_combine, latency): time from the query to its last partial result; 0 if it was sent to one partition."""
    c = partials.groupBy("query_id").agg(F.max("n_sent").alias("n_to_combine"), (F.max("answered") - F.min("event_time")).alias("t"))
    return c.select("query_id", "n_to_combine", F.when(F.col("n_to_combine") > 1, F.col("t")).otherwise(F.lit(0)).cast("bigint").alias("latency"))
