"""k-nearest-neighbour search: exact, with time to live, as of a time, filtered, and per partition.

The stated queries meet all rows in blocks of at most QUERY_BLOCK: a block is broadcast (its size is
bounded), each task chooses candidates by matrix products, compares all that are at the k-th distance
or under it, within rounding, again in double precision and keeps its k first by (dist, id). One narrow pass over the rows, then a
shuffle of k * queries candidates from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.distance import distance, exact, kernel, slack

QUERY_BLOCK, PAIRS, TASK_PAIRS, FOREVER = 8192, 1 << 18, 1 << 23, 2**62


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right length as one matrix, and which rows have one."""
    ok = np.array([x.is_valid and len(x.values) == dim for x in column], dtype=bool)
    flat = [np.asarray(x.values, dtype=np.float64) for x, k in zip(column, ok) if k]
    m = np.stack(flat) if flat else np.empty((0, dim))
    good = np.isfinite(m).all(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    return m[good], ok


def _ranks(ids: pa.Array) -> np.ndarray:
    return np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)


def _first(query: np.ndarray, dist: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each query by (dist, rank)."""
    by = np.lexsort((rank, dist, query))
    q = query[by]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    return by[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, time_filter: str = "none", scope: str = "per_query") -> DataFrame:
    """(query_id, rank, id, dist): the k nearest rows of each query, ties by id.

    rows(id, v[, event_time[, valid_to]]), queries(query_id, v[, event_time, ttl]). With time_filter
    "ge" (or "gt") a row is visible from its event_time to its valid_to (exclusive, null: for ever) and
    only if its event_time is at (or over) max(0, query time - ttl). scope "batch_first": the bounds of
    the earliest query hold for all; "batch_ttl": its ttl does, each query at its own time. Queries
    without k visible rows return what there is. What no query of a block can see is filtered at the
    source: bounds on event_time are pushed to the scan.
    """
    if time_filter not in ("none", "ge", "gt") or scope not in ("per_query", "batch_first", "batch_ttl"):
        raise ValueError((time_filter, scope))
    timed = time_filter != "none"
    clock = ["event_time", "valid_to"] if timed else []
    if timed and "valid_to" not in rows.columns:
        rows = rows.withColumn("valid_to", F.lit(None).cast("bigint"))
    rows = rows.select("id", F.col("v").cast("array<double>").alias("v"), *clock)
    queries = queries.select("query_id", F.col("v").cast("array<double>").alias("v"), *(["event_time", "ttl"] if timed else []))
    if timed and scope == "batch_first":
        first = queries.agg(F.min_by("ttl", F.struct("event_time", "query_id")).alias("ttl"), F.min("event_time").alias("t")).first()
        queries = queries.withColumns({"ttl": F.lit(first["ttl"]), "_t": F.lit(first["t"])})
    elif timed and scope == "batch_ttl":
        queries = queries.withColumn("ttl", F.lit(queries.agg(F.min_by("ttl", F.struct("event_time", "query_id")).alias("ttl")).first()["ttl"]))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    key = dict(rows.dtypes)["id"]
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        one = _block(rows, part, k, metric, time_filter, key)
        out = one if out is None else out.unionByName(one)
    by = Window.partitionBy("query_id").orderBy("dist", "id")
    exact = out.where("dist is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return exact.select("query_id", "rank", "id", "dist")


def _block(rows: DataFrame, part: DataFrame, k: int, metric: str, time_filter: str, key: str) -> DataFrame:
    q = part.toArrow()  # QUERY_BLOCK rows or so
    sizes = {len(x) for x in q.column("v").to_pylist() if x is not None}
    if len(sizes) > 1:
        raise ValueError(f"queries of several lengths: {sorted(sizes)}")
    dim = sizes.pop() if sizes else 0
    qm, ok = _matrix(q.column("v").combine_chunks() if q.num_rows else pa.array([], pa.list_(pa.float64())), dim)
    ids = [x for x, good in zip(q.column("query_id").to_pylist(), ok) if good]
    if time_filter != "none":
        at, ttl = (np.asarray(q.column(c).to_pylist(), dtype=np.float64)[ok] for c in ("event_time", "ttl"))
        begin = np.asarray(q.column("_t").to_pylist(), dtype=np.float64)[ok] if "_t" in q.column_names else at
        low = np.maximum(0, begin - ttl)
        if len(at):
            rows = rows.where(F.col("event_time").between(int(low.min()), int(at.max())))
    else:
        at = low = np.zeros(len(ids))
    shared = rows.sparkSession.sparkContext.broadcast((qm, at, low))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qm, at, low = shared.value
        if not len(qm):
            return
        query, dist, near, ids = np.empty(0, np.int64), np.empty(0), np.empty((0, dim)), None
        step = max(64, 16 * PAIRS // len(qm))  # so many rows at once, for 32 MB of distances
        for whole in it:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                m, good = _matrix(batch.column(1), dim)
                if not len(m):
                    continue
                d = kernel(metric, qm, m)
                if time_filter != "none":
                    ts = np.asarray(batch.column(2).to_pylist(), dtype=np.float64)[good]
                    to = np.array([FOREVER if x is None else x for x in batch.column(3).to_pylist()], dtype=np.float64)[good]
                    seen = (ts[None, :] <= at[:, None]) & (at[:, None] < to[None, :])
                    seen &= ts[None, :] >= low[:, None] if time_filter == "ge" else ts[None, :] > low[:, None]
                    d = np.where(seen, d, np.inf)
                names = batch.column(0).filter(pa.array(good))
                ranks = _ranks(names)
                cut = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                last = np.full(len(d), np.inf)  # the k-th distance so far
                full = np.bincount(query, minlength=len(d)) == k
                np.maximum.at(worst := np.full(len(d), -np.inf), query, dist)
                last[full] = worst[full]
                r, c = np.nonzero((d <= (np.minimum(cut, last) + slack(metric, qm, m))[:, None]) & np.isfinite(d))
                del d
                new = []
                for a in range(0, len(r), PAIRS):  # every row at the cut takes part, however many are tied
                    some = slice(a, a + PAIRS)
                    e = np.concatenate([exact(metric, qm[x], m[y]) for x, y in zip(*(np.array_split(z[some], 8) for z in (r, c)))])
                    top = _first(r[some], e, ranks[c[some]], k)
                    new.append((r[some][top], c[some][top], e[top]))
                if not new:
                    continue
                r, c, e = (np.concatenate(x) for x in zip(*new))
                taken = names.take(pa.array(c))
                ids = taken if ids is None else pa.concat_arrays([ids, taken])
                query, dist, near = np.concatenate([query, r]), np.concatenate([dist, e]), np.concatenate([near, m[c]])
                top = _first(query, dist, _ranks(ids), k)
                query, dist, near, ids = query[top], dist[top], near[top], ids.take(pa.array(top))
        if ids is not None:
            yield pa.record_batch([pa.array(query.astype(np.int32)), ids, pa.array(list(near), pa.list_(pa.float64()))], ["at", "id", "v"])

    near = rows.mapInArrow(search, f"at int, id {key}, v array<double>")
    spark = rows.sparkSession
    named = spark.createDataFrame([(i, x, [float(y) for y in v]) for i, (x, v) in enumerate(zip(ids, qm))], f"at int, query_id {dict(part.dtypes)['query_id']}, qv array<double>")
    return near.join(F.broadcast(named), "at").select("query_id", "id", distance(metric, F.col("qv"), F.col("v")).alias("dist"))


def all_pairs(rows: DataFrame, queries: DataFrame, digits: int, scale: int = 100) -> DataFrame:
    """(query_id, id, l2, ip, cosine, dot, l2_int) of all queries(query_id, v) with all rows(id, v), rounded to `digits`.

    A block of QUERY_BLOCK queries is broadcast at a time; rows are dealt to tasks of TASK_PAIRS pairs or so,
    come past the block and leave in batches of PAIRS or less. Components are added up in the order of the column expressions, and a half is
    rounded away from zero. l2_int compares the whole parts of `scale` times each component. Null where a vector or a
    component is, and where lengths differ; the cosine also where a vector is zero, l2_int where a component is not finite.
    """
    types = dict(rows.dtypes) | dict(queries.dtypes)
    schema = f"query_id {types['query_id']}, id {types['id']}, l2 double, ip double, cosine double, dot double, l2_int bigint"
    as_double = F.col("v").cast("array<double>").alias("v")
    rows, queries = rows.select("id", as_double), queries.select("query_id", as_double)
    n = queries.count()
    blocks, tasks = max(1, -(-n // QUERY_BLOCK)), -(-n * rows.count() // TASK_PAIRS)
    rows = rows.repartition(tasks, "id") if tasks > 1 else rows
    out = None
    for b in range(blocks):
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        shared = rows.sparkSession.sparkContext.broadcast((part.column("query_id").combine_chunks(), _by_length(part.column("v").combine_chunks())))
        one = rows.mapInArrow(_pairs(shared, digits, scale), schema)
        out = one if out is None else out.unionByName(one)
    return out


def _by_length(v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that hold no null, and their matrix."""
    lengths = np.array([len(x.values) if x.is_valid and not x.values.null_count else -1 for x in v], np.int64)
    return {int(n): (at := np.flatnonzero(lengths == n), np.stack([np.asarray(v[int(i)].values, np.float64) for i in at])) for n in np.unique(lengths[lengths >= 0])}


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to so many digits, a half away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    y = np.where(np.abs(y - whole) == 0.5, whole + np.sign(y), np.rint(y)) / 10.0**digits
    return np.where(np.isfinite(y), y, x)


def _pairs(shared, digits: int, scale: int):
    def metrics(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """Of all queries with all rows, a row's queries together."""
        shape = (len(r), len(q))
        l2, dot, whole = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)
        qi, ri = (np.floor(np.nan_to_num(x, posinf=0.0, neginf=0.0) * scale).astype(np.int64) for x in (q, r))
        qq, rr = np.zeros(len(q)), np.zeros(len(r))
        for k in range(q.shape[1]):
            a, b = q[:, k], r[:, k]
            d = a[None, :] - b[:, None]
            l2 += d * d
            dot += a[None, :] * b[:, None]
            qq += a * a
            rr += b * b
        for k in range(q.shape[1]):
            d = qi[:, k][None, :] - ri[:, k][:, None]
            whole += d * d
        norm = np.sqrt(qq[None, :] * rr[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = 1.0 - dot / norm
        return [l2, 1.0 - dot, np.where(norm == 0, np.nan, cosine), dot, whole, norm == 0, ~(np.isfinite(q).all(axis=1)[None, :] & np.isfinite(r).all(axis=1)[:, None])]

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        step = max(1, PAIRS // 4 // max(1, len(names)))  # so many rows at once: their pairs stay in the cache
        for batch in it:
            for i in range(0, batch.num_rows if len(names) else 0, step):
                some = batch.slice(i, step)
                n = some.num_rows
                values = [np.full((n, len(names)), 0.0) for _ in range(4)] + [np.zeros((n, len(names)), np.int64)]
                known, zero, odd = (np.zeros((n, len(names)), dtype=bool) for _ in range(3))
                for length, (at, r) in _by_length(some.column(1)).items():
                    if length in queries:
                        where, q = queries[length]
                        cells = np.ix_(at, where)
                        *found, zero[cells], odd[cells] = metrics(q, r)
                        for x, y in zip(values, found):
                            x[cells] = y
                        known[cells] = True
                masks = [~known, ~known, ~known | zero, ~known, ~known | odd]
                columns = [pa.array(_half_up(x.ravel(), digits) if k < 4 else x.ravel(), mask=masks[k].ravel()) for k, x in enumerate(values)]
                every = np.arange(n * len(names))
                yield pa.record_batch([names.take(pa.array(every % len(names))), some.column(0).take(pa.array(every // len(names))), *columns], ["query_id", "id", "l2", "ip", "cosine", "dot", "l2_int"])

    return search


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, n_found, n_hit, recall) of (query_id, id) rows; the denominator is what was found."""
    hit = truth.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    return found.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n_found"), F.count("hit").alias("n_hit")).withColumn("recall", F.col("n_hit") / F.col("n_found"))


def as_text(results: DataFrame, duration: Column) -> DataFrame:
    """(query_id, line): `query duration (id,dist)*` in order of rank, as result files hold it."""
    pair = F.struct("rank", F.concat(F.lit("("), F.col("id").cast("string"), F.lit(","), F.format_string("%.9f", F.col("dist")), F.lit(")")).alias("s"))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(pair)).alias("p")).select("query_id", F.concat_ws(" ", F.col("query_id").cast("string"), duration.cast("string"), F.array_join(F.transform("p", lambda x: x["s"]), " ")).alias("line"))
