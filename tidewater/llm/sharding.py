"""Sharding: vector bin packing of groups of equal texts over bytes, tokens and rows.

A group goes to the shard where the dot product of its vector with the residual capacities (all as
shares of the totals) is highest. The driver only sees a bounded number of items: groups are hashed
into BUCKETS buckets, except those that hold more than 1/HEAVY of any total, which are items of
their own (3 * HEAVY at most); a group of over a quarter of a shard is cut into pieces, since it
could not be balanced whole. Slots are numbered within bounded units, then offset.

Defined results: a null text counts as empty (size 1, no token, crc32 0); repeated rows are one
group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import Scratch

BUCKETS, HEAVY = 4096, 1024


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, tokens, crc, h) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h"),
    )


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item by the dot-product rule, largest items first; among bins with room in bytes, else all."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    order = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
    left = np.full((bins, share.shape[1]), 1.0 / bins)
    out = np.zeros(len(share), dtype=np.int64)
    for i in order:
        fit = left @ share[i]
        room = (left >= share[i] - 1e-12).all(axis=1)
        k = int(np.argmax(np.where(room, fit, -np.inf))) if room.any() else int(np.argmax(left[:, 0] if share[i, 0] * 2 >= share[i].max() else fit))
        left[k] -= share[i]
        out[i] = k
    return out


def shard(docs: DataFrame, bins: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, tokens, crc, shard, slot."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.keep(measured(docs, id_col, text_col), "rows")
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    key = ["h", "crc", "size"]
    sums = {"b": total["size"] or 1, "t": total["tokens"] or 1, "n": total["n"] or 1}
    groups = rows.groupBy(*key).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    share = F.greatest(*[F.col(c) / F.lit(float(v)) for c, v in sums.items()])
    heavy = groups.withColumn("share", share).where(F.col("share") > 1.0 / HEAVY).orderBy(*key).collect()  # 3 * HEAVY at most
    listed = [(r["h"], r["crc"], r["size"], i, int(np.ceil(r["share"] * HEAVY)), r["share"] > 0.25 / bins) for i, r in enumerate(heavy)]
    table = docs.sparkSession.createDataFrame(listed, "h long, crc long, size long, heavy int, pieces int, cut boolean") if listed else None
    bucket = F.pmod(F.xxhash64("h", "crc"), F.lit(BUCKETS))
    if table is None:
        units = rows.withColumns({"unit": bucket, "item": bucket})
    else:
        piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
        unit = F.when(F.col("heavy").isNull(), bucket).otherwise(BUCKETS + F.col("heavy") * (HEAVY + 1) + piece)
        item = F.when(F.col("heavy").isNull(), bucket).when(F.col("cut"), unit).otherwise(BUCKETS + F.col("heavy") * (HEAVY + 1))
        units = rows.join(F.broadcast(table), key, "left").withColumns({"unit": unit, "item": item})
    units = units.select("id", "size", "tokens", "crc", "unit", "item")
    tally = units.groupBy("unit", "item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("unit").collect()  # BUCKETS + 6 * HEAVY at most
    items = sorted({r["item"] for r in tally})
    at = {k: i for i, k in enumerate(items)}
    vectors = np.zeros((len(items), 3))
    for r in tally:
        vectors[at[r["item"]]] += (r["b"], r["t"], r["n"])
    bin_of = place(vectors, bins)
    filled, offsets = [0] * bins, []
    for r in tally:
        k = int(bin_of[at[r["item"]]])
        offsets.append((r["unit"], k, filled[k]))
        filled[k] += r["n"]
    to = docs.sparkSession.createDataFrame(offsets, "unit long, shard int, first long")
    numbered = units.withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy("id", "crc")))
    return numbered.join(F.broadcast(to), "unit").select("id", "size", "tokens", "crc", "shard", (F.col("first") + F.col("k") - 1).alias("slot"))
