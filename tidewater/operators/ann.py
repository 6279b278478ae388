"""Search that skips segments, and the packed codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import codec
from tidewater.functions.distance import l2_squared
from tidewater.operators import partitioners


def segments(rows: DataFrame, segment: str = "segment") -> list[tuple[int, list[float], float]]:
    """(segment, centroid, radius) of each segment; the number of segments is the caller's and small."""
    means = rows.select(segment, F.posexplode("v")).groupBy(segment, "pos").agg(F.avg(F.col("col").cast("double")).alias("a"))
    centers = means.groupBy(segment).agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("c")).select(segment, F.transform("c", lambda x: x["a"]).alias("c"))
    reach = rows.join(F.broadcast(centers), segment).groupBy(segment).agg(F.sqrt(F.max(l2_squared(F.col("v"), F.col("c")))).alias("r"))
    return [(r[segment], list(r["c"]), r["r"]) for r in centers.join(reach, segment).orderBy(segment).collect()]


def early_stop(rows: DataFrame, queries: DataFrame, k: int, first: int, factor: float = 1.0) -> DataFrame:
    """k-NN that visits each query's `first` nearest segments, then only those that could still hold a nearer row.

    The rule is ours: a segment is skipped when its centroid is further than its radius plus `factor`
    times the distance of the k-th row so far. At factor 1 the result is exact; below, it may lose rows.
    rows(segment, id, v), queries(query_id, v).
    """
    known = segments(rows)
    gaps = F.array_sort(F.array(*[F.struct(F.sqrt(l2_squared(F.col("v"), F.array(*map(F.lit, c)))).alias("d"), F.lit(s).alias("s"), F.lit(r).alias("r")) for s, c, r in known]))
    ordered = queries.select("query_id", "v", gaps.alias("gaps"))
    held = rows.select(F.col("segment").alias("partition_id"), "id", "v")

    def visit(q: DataFrame) -> DataFrame:
        return partitioners.ranked(partitioners.merged(partitioners.search(held, q, k), k))

    near = ordered.select("query_id", "v", F.explode(F.slice("gaps", 1, first)).alias("g")).select("query_id", "v", F.col("g.s").alias("partition_id"), F.lit(first).alias("n_sent"))
    one = visit(near)
    kth = one.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("dist"))).alias("kth"))
    rest = ordered.join(kth, "query_id", "left").select("query_id", "v", "kth", F.explode(F.slice("gaps", first + 1, len(known))).alias("g"))
    open_ = rest.where(F.col("kth").isNull() | (F.col("g.d") - F.col("g.r") <= F.col("kth") * factor + 1e-9))
    two = visit(open_.select("query_id", "v", F.col("g.s").alias("partition_id"), F.lit(len(known)).alias("n_sent")))
    both = one.unionByName(two).groupBy("query_id", "id").agg(F.min("dist").alias("dist"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def codec_roundtrip(rows: DataFrame) -> DataFrame:
    """(id, v): vectors that went through the packed form; rows of one dimension."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"id": pdf["id"], "v": list(codec.unpack(codec.pack(x), *x.shape))})

    return rows.select("id", "v").mapInPandas(run, "id long, v array<float>")
