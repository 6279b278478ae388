"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is a min per node and a join, so no node's neighbours are ever gathered in one task, and a
node that a third of all edges touch only makes one skewed join side, which Spark splits. Each round
is written to the shared folder. Labels are the smallest node id of the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import Scratch

#: Up to so many edges go through a round in one task, without exchanges.
FEW = 10_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges(u, v), in either direction, repeats and loops allowed -> (node, component) of all touched nodes but the smallest of each."""
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    seen = now.agg(sign.alias("x")).first()["x"]
    for k in range(1, most_rounds + 1):
        if not seen["n"]:
            break
        now = now.coalesce(1) if seen["n"] <= FEW else now
        now = scratch.keep(_small(_large(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        found = now.agg(sign.alias("x")).first()["x"]
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
