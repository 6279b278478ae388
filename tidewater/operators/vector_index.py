"""A stored vector index: graph segments per shard, written by batches, searched at a time, compacted.

Each batch of mutations becomes one segment: per shard a navigable graph of its inserted vectors and a
list of its tombstones, with versions and event times, as rows of Parquet. Nothing stored is changed:
an update is a newer version in a later segment, a deletion a tombstone, and a search tells what it may
see by the versions of all segments of a shard. Compaction writes the surviving versions as one
segment. Searches read only segments whose times a query can reach (the bounds are columns, so the
scan is filtered). A shard's segments are one task's work; the number of shards is an option.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.distance import exact as exactly
from tidewater.functions.distance import kernel, slack
from tidewater.operators.changelog import latest
from tidewater.operators.graph_index import WHOLE, Graph
from tidewater.operators.knn import FOREVER, PAIRS, _first

MASK = 1 << 21  # visible nodes of so many pairs are told at once
_SEGMENT = "segment int, shard int, n long, low long, high long, ids binary, versions binary, times binary, x binary, level binary, near array<binary>, dead binary"
DEFAULTS = {"shards": 4, "width": 64, "dim": None}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, **options) -> None:
    """A new, empty index; options as in DEFAULTS. It is an error if there is one."""
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    p, fs = _fs(spark, path)
    if fs.exists(p):
        raise ValueError(f"{path} exists")
    set_options(spark, path, **(DEFAULTS | options))


def options(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/options").orderBy(F.desc("value")).first()[0].split(" ", 1)[1])


def set_options(spark: SparkSession, path: str, **new) -> None:
    """Options are rows with a running number; the newest counts. The number of shards cannot change."""
    p, fs = _fs(spark, f"{path}/options")
    old, n = (options(spark, path), spark.read.text(f"{path}/options").count()) if fs.exists(p) else ({}, 0)
    if old and new.get("shards", old["shards"]) != old["shards"]:
        raise ValueError("the number of shards is fixed")
    spark.createDataFrame([(f"{n:09d} {json.dumps(old | new)}",)], "value string").write.mode("append").text(f"{path}/options")


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p, fs = _fs(spark, f"{path}/segments")
    return spark.read.schema(_SEGMENT).parquet(f"{path}/segments") if fs.exists(p) else None


def _numbers(raw, kind=np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _write(rows: DataFrame, segment: int, shards: int, path: str) -> None:
    """rows(op, id, v, version, event_time), one for each id and version, as the graphs of one segment."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        put = pdf[pdf["op"] == "I"].sort_values("id", ignore_index=True)
        gone = pdf[pdf["op"] == "D"]
        dead = gone[["id", "version", "event_time"]].to_numpy(np.int64)
        one = {"segment": segment, "shard": key[0], "n": len(put), "low": int(pdf["event_time"].min()), "high": int(pdf["event_time"].max()), "dead": dead.tobytes()}
        one |= {"ids": b"", "versions": b"", "times": b"", "x": b"", "level": b"", "near": []}
        if len(put):
            x = np.stack(put["v"].to_numpy()).astype(np.float64)
            g = Graph(_unit(x), put["id"].to_numpy())
            ids, versions, times = (put[c].to_numpy(np.int64)[g.order].tobytes() for c in ("id", "version", "event_time"))
            one |= {"ids": ids, "versions": versions, "times": times, "x": x[g.order].tobytes(), "level": g.level.astype(np.int64).tobytes(), "near": [a.tobytes() for a in g.near]}
        return pd.DataFrame([one])

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    usable = F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
    each = rows.where((F.col("op") == "D") | usable).select(shard, "op", F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("version").cast("bigint").alias("version"), F.col("event_time").cast("bigint").alias("event_time"))
    each.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(build, _SEGMENT).write.mode("append").parquet(f"{path}/segments")


def upsert(spark: SparkSession, path: str, mutations: DataFrame) -> None:
    """One batch of mutations(op I or D, id, v, version, event_time) as a new segment.

    Of rows of one id the newest version counts; older versions than the stored ones are kept, and
    searches leave them out. Null and zero vectors are not indexed.
    """
    how, stored = options(spark, path), _stored(spark, path)
    last = stored.agg(F.max("segment")).first()[0] if stored is not None else None
    _write(latest(mutations.select("op", "id", "v", "version", "event_time"), "id", "version"), 0 if last is None else last + 1, how["shards"], path)


def _timeline(parts: list[dict]) -> list[np.ndarray]:
    """For each segment's nodes the time of their id's next version, which hides them (or FOREVER)."""
    rows = []
    for s, p in enumerate(parts):
        ids, versions, times = (_numbers(p[c]) for c in ("ids", "versions", "times"))
        rows.append(np.stack([ids, versions, times, np.full(len(ids), s), np.arange(len(ids))], axis=1))
        dead = _numbers(p["dead"]).reshape(-1, 3)
        rows.append(np.concatenate([dead, np.full((len(dead), 2), -1)], axis=1))
    every = np.concatenate(rows)
    by = np.lexsort((every[:, 1], every[:, 0]))
    every = every[by]
    to = np.full(len(every), FOREVER)
    same = np.flatnonzero(every[1:, 0] == every[:-1, 0])
    to[same] = every[same + 1, 2]
    out = [np.full(len(_numbers(p["ids"])), FOREVER) for p in parts]
    for s in range(len(parts)):
        mine = every[:, 3] == s
        out[s][every[mine, 4]] = to[mine]
    return out


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, width: int | None = None, strict: bool = False, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, dist, segment): the k nearest by squared L2 of what graph walks meet, ties by id.

    queries(query_id, v[, event_time, ttl]): a vector is seen from its event time until a newer version's,
    if its time is at (`strict`: over) the query's time less ttl or later; without times, the newest
    versions are searched. Walks go by cosine and pass through vectors that a query may not see but do not
    return them; a beam with fewer than k visible vectors is widened. Where a query sees less than half of a
    graph and no more than a walk would meet (WHOLE for each place of the beam), all that it sees is compared.
    `exact`: after the walks, whatever may be nearer than the k-th vector met is compared too.
    """
    how, stored = options(spark, path), _stored(spark, path)
    width = width or how["width"]
    timed = "event_time" in queries.columns
    at, ttl = (F.col("event_time"), F.col("ttl")) if timed else (F.lit(FOREVER - 1), F.lit(FOREVER))
    asked = queries.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("v").cast("array<double>").alias("qv"), at.cast("bigint").alias("at"), F.greatest(F.lit(0), at - ttl).cast("bigint").alias("bound"))
    result = "query_id long, id long, dist double, segment int"
    if stored is None:
        near = spark.createDataFrame([], result)
    else:
        if timed:
            reach = asked.agg(F.min("bound"), F.max("at")).first()
            if reach[0] is not None:
                stored = stored.where((F.col("high") >= int(reach[0])) & (F.col("low") <= int(reach[1])))
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(how["shards"] - 1))))

        def walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            parts = left.sort_values("segment").to_dict("records")
            found = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int64))]
            right = right.sort_values("at")  # queries that see the same vectors come together
            if len(right) and parts:
                q, now, low = np.stack(right["qv"].to_numpy()).astype(np.float64), right["at"].to_numpy(), right["bound"].to_numpy()
                for p, hidden in zip(parts, _timeline(parts)):
                    if not p["n"]:
                        continue
                    x, times, ids = _numbers(p["x"], np.float64).reshape(p["n"], -1), _numbers(p["times"]), _numbers(p["ids"])

                    def visible(some: np.ndarray) -> np.ndarray:
                        to, since = now[some, None], low[some, None]
                        return (times <= to) & (to < hidden) & ((times > since) if strict else (times >= since))

                    g = Graph.restored(_unit(x), _numbers(p["level"]), list(p["near"]))
                    for r, c, d in _walked(g, x, ids, q, k, width, visible, exact):
                        found.append((r, ids[c], d, np.full(len(r), p["segment"])))
            r, i, d, s = (np.concatenate(z) for z in zip(*found))
            top = _first(r, d, i, k)
            return pd.DataFrame({"query_id": right["query_id"].to_numpy()[r[top]] if len(top) else r, "id": i[top], "dist": d[top], "segment": s[top]})

        stored, sent = (x.repartitionById(how["shards"], F.col("shard")) for x in (stored, sent))
        near = stored.groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(walk, result)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist", "segment")


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, squared L2): the k first of each query among the candidates (r, c), by distance and id."""
    out = []
    for a in range(0, len(r), PAIRS):
        rr, cc = r[a : a + PAIRS], c[a : a + PAIRS]
        d = np.concatenate([exactly("l2", q[y], x[z]) for y, z in zip(np.array_split(rr, 8), np.array_split(cc, 8))])
        top = _first(rr, d, ids[cc], k)
        out.append((rr[top], cc[top], d[top]))
    if not out:
        return r, c, np.empty(0)
    rr, cc, d = (np.concatenate(z) for z in zip(*out))
    top = _first(rr, d, ids[cc], k)
    return rr[top], cc[top], d[top]


def _walked(g: Graph, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, width: int, visible, whole: bool):
    """(query, node, squared L2) of the k nearest visible nodes met; visible(queries) is a mask of all nodes for each. `whole`: of all."""
    n, unit = len(x), _unit(q)
    todo, width, step = np.arange(len(q)), max(k, width), max(1, min(128, MASK // len(x)))
    while len(todo):
        again = []
        width = min(width, n)
        for a in range(0, len(todo), step):
            some = todo[a : a + step]
            seen = visible(some)
            number = seen.sum(axis=1)
            few = (number > 0) & (((number <= WHOLE * width) & (2 * number <= n)) | (width == n))
            for part, bound in ((np.flatnonzero(few), None), (np.flatnonzero((number > 0) & ~few), True)):
                if not len(part):
                    continue
                if bound:
                    nodes, _ = g.beam(unit[some[part]], g._enter(unit[some[part]], 0, n), 0, width, n)
                    good = (nodes >= 0) & np.take_along_axis(seen[part], np.maximum(nodes, 0), axis=1)
                    full = good.sum(axis=1) >= k
                    again.append(some[part[~full]])
                    part, nodes, good = part[full], nodes[full], good[full]
                    r, c = np.nonzero(good)
                    r, c, d = _nearest(x, ids, q, some[part][r], nodes[r, c], k)
                    if not whole:
                        yield r, c, d
                        continue
                    bound = d[np.flatnonzero(np.append(r[1:] != r[:-1], True))] if len(r) else d  # the k-th of each
                    if not len(part):
                        continue
                columns = np.flatnonzero(seen[part].any(axis=0))
                y, mask = x[columns], seen[np.ix_(part, columns)]
                d = np.where(mask, kernel("l2", q[some[part]], y), np.inf)
                if bound is None:
                    bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                r, c = np.nonzero((d <= (bound + slack("l2", q[some[part]], y))[:, None]) & mask)
                yield _nearest(x, ids, q, some[part][r], columns[c], k)
        todo, width = np.concatenate(again) if again else todo[:0], width * 2


def feedback(results: DataFrame) -> DataFrame:
    """(query_id, segment, n, total): how many results each segment gave, and the sum of their distances, in order of rank."""
    each = F.array_sort(F.collect_list(F.struct("rank", "dist")))  # k of a query at most
    return results.groupBy("query_id", "segment").agg(F.count("*").alias("n"), F.aggregate(each, F.lit(0.0), lambda s, x: s + x["dist"]).alias("total"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(op, id, v, version, event_time, segment): all that is stored, read back."""

    def unpack(it):
        for pdf in it:
            for p in pdf.to_dict("records"):
                dead = _numbers(p["dead"]).reshape(-1, 3)
                yield pd.DataFrame({"op": "D", "id": dead[:, 0], "v": None, "version": dead[:, 1], "event_time": dead[:, 2], "segment": p["segment"]})
                if p["n"]:
                    x = _numbers(p["x"], np.float64).reshape(p["n"], -1)
                    yield pd.DataFrame({"op": "I", "id": _numbers(p["ids"]), "v": list(x), "version": _numbers(p["versions"]), "event_time": _numbers(p["times"]), "segment": p["segment"]})

    return _stored(spark, path).mapInPandas(unpack, "op string, id long, v array<double>, version long, event_time long, segment int")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The newest live versions of an index as an index of one segment in another place."""
    create(spark, into, **options(spark, path))
    rows = latest(versions(spark, path).drop("segment"), "id", "version")
    _write(rows.where("op = 'I'"), 0, options(spark, path)["shards"], into)
