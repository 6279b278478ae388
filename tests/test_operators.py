"""Operators against plain Python models."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import ann, changelog, knn, kv, merge_operators, partitioners, trace, vector_index
from tidewater.operators.graph_index import Graph
from tidewater.session import Scratch
from tidewater.streaming import search as streaming
from tidewater.streaming.search import SearchProcessor


def test_filter_never_leaks_and_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()], rng.randrange(100), rng.choice([None, 120, 150])) for i in range(300)]
    queries = [(i, [rng.random(), rng.random()], rng.randrange(60, 160), rng.randrange(1, 90)) for i in range(12)]
    r = spark.createDataFrame(rows, "id long, v array<double>, event_time long, valid_to long").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, v array<double>, event_time long, ttl long")
    for how in ("ge", "gt"):
        got = {}
        for x in knn.nearest(r, q, 4, time_filter=how).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["id"]))
        for i, v, t, ttl in queries:
            low = max(0, t - ttl)
            ok = [(sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w, ts, to in rows if ts <= t and (to is None or t < to) and (ts >= low if how == "ge" else ts > low)]
            assert sorted(got.get(i, [])) == [(n + 1, j) for n, (_, j) in enumerate(sorted(ok)[:4])]


def test_knn_edges(spark):
    schema = "id long, v array<double>"
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, v array<double>")
    assert knn.nearest(spark.createDataFrame([], schema), q, 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (5, [1.0, 0.0]), (4, [0.0, 1.0])], schema)
    assert [r["id"] for r in knn.nearest(odd, q, 3).orderBy("rank").collect()] == [4, 5]
    with pytest.raises(ValueError):
        knn.nearest(odd, q, 3, time_filter="no")


def test_ties_go_to_the_smallest_ids(spark):
    """A group of equal vectors at the cut, far larger than k: the smallest ids of it."""
    ids = list(range(300))
    random.Random(4).shuffle(ids)
    rows = [(i, [0.3, 0.1, 0.7]) for i in ids] + [(1000 + i, [5.0 + i, 1.0, 0.0]) for i in range(50)]
    r = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.1, 0.2, 0.9])], "query_id long, v array<double>")
    for metric in ("l2", "cosine"):
        assert [x["id"] for x in knn.nearest(r, q, 10, metric).orderBy("rank").collect()] == list(range(10))
        parts = partitioners.search(r.withColumn("partition_id", F.lit(0)), q.withColumns({"partition_id": F.lit(0), "n_sent": F.lit(1)}), 10, metric).first()
        assert [x["id"] for x in parts["neighbors"]] == list(range(10))
    live = {i: (np.array(v), 5, i) for i, v in rows}
    assert [x["id"] for x in SearchProcessor(10)._nearest(live, np.array([0.1, 0.2, 0.9]), 9, 0)] == list(range(10))


def test_key_value_equals_dict(spark):
    rng = random.Random(5)
    log, model = [], {}
    for seq in range(400):
        k, op = rng.randrange(40), rng.choice(["PUT", "PUT", "DEL"])
        log.append((k, seq, op, float(seq)))
        if op == "PUT":
            model[k] = float(seq)
        else:
            model.pop(k, None)
    got = {r["k"]: r["v"] for r in kv.view(spark.createDataFrame(log, "k long, seq long, op string, v double")).collect()}
    assert got == model


def test_range_delete(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(50)) for k in range(-30, 60)]
    cuts = [(b, b + rng.randrange(-2, 40), rng.randrange(50)) for b in range(-40, 60, 7)]
    got = {r["k"] for r in changelog.range_deleted(spark.createDataFrame(rows, "k long, seq long"), spark.createDataFrame(cuts, "b long, e long, seq long")).collect()}
    assert got == {k for k, s in rows if not any(b <= k < e and t > s for b, e, t in cuts)}


def test_delete_older_than_insert_does_not_hide(spark):
    log = spark.createDataFrame([("D", 1, 5, 1), ("I", 1, 9, 2), ("I", 2, 1, 3), ("D", 2, 2, 4), ("I", 2, 3, 5)], "op string, id long, event_time long, seq long")
    assert {r["id"] for r in changelog.live(log, "id", "seq").collect()} == {1, 2}


def test_merge_switch(spark):
    """A switch folds what was; an unknown name, or none after a name, or none at all, packs the operands."""
    rows = [(1, 0, None, 2.0), (1, 1, "sum", 3.0), (1, 2, "sum", 4.0), (1, 3, "max", 5.0), (2, 0, None, 1.0), (3, 0, "sum", 1.0), (3, 1, None, 2.0), (3, 2, "sum", 3.0), (4, 0, "what", 1.0), (4, 1, "sum", 2.0), (5, 0, "sum", 2.0), (5, 1, "what", 3.0)]
    got = {r["k"]: (r["func"], r["v"], r["packed"]) for r in merge_operators.switching(spark.createDataFrame(rows, "k long, seq long, func string, v double")).collect()}
    assert got == {1: ("max", 9.0, None), 2: ("error", None, [1.0]), 3: ("error", None, [1.0, 2.0, 3.0]), 4: ("error", None, [1.0, 2.0]), 5: ("error", None, [2.0, 3.0])}


def test_uint64_wraps(spark):
    rows = spark.createDataFrame([(1, 0, 2**63 - 1), (1, 1, 2**63 - 1), (1, 2, 5)], "k long, seq long, v long")
    assert int(merge_operators.merge(rows, "uint64add").first()["v"]) == (2 * (2**63 - 1) + 5) % 2**64


def test_heads_are_exact_quantiles(spark):
    keys = [random.Random(9).randrange(30) for _ in range(101)]
    got = partitioners.heads(spark.createDataFrame([(k,) for k in keys], "key long"), 5)
    assert got == sorted({sorted(keys)[101 * i // 5] for i in range(1, 5)})


def test_routing_rules(spark):
    rows = spark.createDataFrame([("D", 1, None), ("D", 2, [1.0]), ("I", 3, [1.0])], "op string, id long, v array<double>")
    n = {r["id"]: r["n"] for r in partitioners.routed(rows, partitioners.simple(F.col("id"), 4), 4, op="op").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 4, 2: 1, 3: 1}
    with pytest.raises(Exception, match="not a query"):
        partitioners.routed(rows, partitioners.simple(F.col("id"), 4), 4, query=True, op="op").collect()
    ring = spark.range(1).select(partitioners.with_ring(F.array(F.lit(0)), 5, 1), partitioners.with_ring(F.array(F.lit(0)), 5, 3)).first()
    assert ring[0] == [0] and sorted(ring[1]) == [0, 1, 4]


def test_empty_partitions_answer(spark):
    rows = spark.createDataFrame([(0, 1, [1.0])], "partition_id int, id long, v array<double>")
    q = spark.createDataFrame([(0, 7, [0.0], 2), (1, 7, [0.0], 2)], "partition_id int, query_id long, v array<double>, n_sent int")
    got = partitioners.merged(partitioners.search(rows, q, 3), 3).first()
    assert got["complete"] and [x["id"] for x in got["neighbors"]] == [1]


def test_stage_clock_and_rates(spark):
    assert changelog.interval_ns(1000) == 1_000_000 and changelog.interval_ns(0) == 0 and changelog.interval_ns(-2) == 2_000_000_000
    with pytest.raises(ValueError):
        changelog.stage_clock(spark.range(1), [5, 1], [1, 1], "id")


def test_graph_recall():
    x = np.random.default_rng(2).normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, np.arange(3000))
    ids, _ = g.nearest(x[:100], 10, 64)
    truth = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(g.order[a]) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.9


def test_early_stop_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 5, (rng.normal(size=4) + i % 5).tolist()) for i in range(200)], "id long, segment int, v array<double>")
    q = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    a = {(r["query_id"], r["rank"], r["id"]) for r in ann.early_stop(rows, q, 5, 1).collect()}
    assert a == {(r["query_id"], r["rank"], r["id"]) for r in knn.nearest(rows, q, 5).collect()}


def test_index_life_cycle(spark):
    """Versions, updates, deletions, re-insertion, filters by time, options, compaction and drop."""
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 6))
    path = f"{Scratch(spark, 'index').dir}/v"
    vector_index.create(spark, path, shards=3, width=8)
    with pytest.raises(ValueError):
        vector_index.create(spark, path)
    with pytest.raises(ValueError):
        vector_index.set_options(spark, path, shards=4)
    schema = "op string, id long, v array<double>, version long, event_time long"
    log = []

    def put(*rows):
        log.extend(rows)
        vector_index.upsert(spark, path, spark.createDataFrame(list(rows), schema))

    empty = vector_index.search(spark, path, spark.createDataFrame([(0, x[0].tolist())], "query_id long, v array<double>"), 3)
    assert empty.count() == 0
    put(*[("I", i, x[i].tolist(), 1, 100 + i) for i in range(50)], ("I", 50, None, 1, 100), ("I", 51, [0.0] * 6, 1, 100))
    put(*[("I", i, x[(i + 1) % 50].tolist(), 2, 300 + i) for i in range(0, 50, 7)], *[("D", i, None, 2, 300) for i in range(3, 50, 7)])
    put(("I", 3, x[55].tolist(), 4, 500), ("I", 4, x[56].tolist(), 0, 600), ("D", 7, None, 9, 510))
    queries = [(q, x[q].tolist(), t, ttl) for q in range(0, 60, 6) for t, ttl in ((250, 1000), (400, 150), (1000, 2000))]
    asked = spark.createDataFrame([(n, v, t, ttl) for n, (_, v, t, ttl) in enumerate(queries)], "query_id long, v array<double>, event_time long, ttl long")

    def seen(t, ttl):
        out = {}
        for i in {m[1] for m in log}:
            mine = sorted((m for m in log if m[1] == i and (m[0] == "D" or m[2])), key=lambda m: m[3])
            for m, after in zip(mine, [*mine[1:], None]):
                if m[0] == "I" and any(m[2]) and max(0, t - ttl) <= m[4] <= t and (after is None or t < after[4]):
                    out.setdefault(i, []).append(m[2])
        return [(i, v) for i, vs in out.items() for v in vs]

    got = {}
    for row in vector_index.search(spark, path, asked, 5, width=60).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["id"]))
    for n, (_, v, t, ttl) in enumerate(queries):
        unit = lambda a: np.array(a) / np.linalg.norm(a)
        by_segment = {}
        for i, w in seen(t, ttl):
            by_segment.setdefault(i, []).append(w)
        live = sorted((-float(unit(v) @ unit(w)), i) for i, ws in by_segment.items() for w in ws)
        assert {i for _, i in got.get(n, [])} <= {i for _, i in live} and len(got.get(n, [])) == min(5, len(live))
    vector_index.compact(spark, path, path + "2")
    kept = {(r["id"], r["version"]) for r in vector_index.versions(spark, path + "2").collect()}
    newest = {}
    for m in sorted(log, key=lambda m: m[3]):
        if m[0] == "D" or (m[2] and any(m[2])):
            newest[m[1]] = m
    assert kept == {(i, m[3]) for i, m in newest.items() if m[0] == "I"}
    vector_index.drop(spark, path)
    assert vector_index._stored(spark, path) is None


def test_stack_distance_and_misses(spark):
    rng = random.Random(3)
    keys = [rng.randrange(30) for _ in range(500)]
    log = spark.createDataFrame(list(enumerate(keys)), "n long, k long")
    got = {r["n"]: r["distance"] for r in trace.stack_distance(log, 1, "k", "n").collect()}
    for n, k in enumerate(keys):
        last = max((i for i in range(n) if keys[i] == k), default=None)
        assert got[n] == (-1 if last is None else len(set(keys[last + 1 : n])))
    for capacity, misses in ((r["capacity"], r["misses"]) for r in trace.miss_ratio(log, 1, [4, 16], "k", "n").collect()):
        cache, want = [], 0
        for k in keys:
            want += k not in cache
            cache = [x for x in cache if x != k][-(capacity - 1) :] + [k]
        assert misses == want


def test_tombstones_are_bounded_by_the_retention(spark):
    """An old insert after its deletion stays dead; one older than the retention is dropped; both over several micro-batches."""
    row = lambda op, i, t, seq, v: (op, i, v, t, seq, 10**9, 1, 0)
    batches = [
        [row("I", 1, 10, 1, [1.0]), row("I", 2, 10, 1, [2.0]), row("D", 3, 50, 2, None)],
        [row("D", 1, 60, 2, None), row("I", 3, 40, 1, [3.0])],
        [row("I", 1, 55, 1, [1.5]), row("I", 4, 400, 1, [4.0])],
        [row("I", 5, 250, 1, [5.0]), row("I", 6, 350, 1, [6.0]), row("Q", 9, 500, 0, [0.0])],
    ]
    scratch = Scratch(spark, "retention")
    schema = "op string, id long, v array<double>, event_time long, seq long, ttl long, n_sent int, partition_id int"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{scratch.dir}/rows")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.dir}/rows")
    found = {k: [x["id"] for x in streaming.replay(streaming.search(stream(), 9, k), "retention").first()["neighbors"]] for k in (None, 100)}
    assert found == {None: [2, 4, 5, 6], 100: [2, 4, 6]}


def test_unfinished_merges_are_released(spark):
    """A query whose partitions do not all answer is given up after the timeout, with what has come."""
    scratch = Scratch(spark, "timeout")
    schema = streaming.PARTIAL
    rows = [[(1, 0, 2, False, [(1.0, 7)]), (2, 0, 1, False, [(2.0, 8)])], [(3, 0, 1, False, [])], [(4, 0, 1, False, [])]]
    for b in rows:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{scratch.dir}/rows")
    stream = streaming.merge(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.dir}/rows"), 3, timeout=1)
    with streaming._rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", f"{scratch.dir}/out").option("checkpointLocation", f"{scratch.dir}/state").trigger(processingTime="1 second").start()
        begun, got = time.time(), {}
        while time.time() - begun < 90 and len(got) < 4:
            time.sleep(2)
            out = spark.read.schema(streaming.MERGED).parquet(f"{scratch.dir}/out").collect() if q.recentProgress else []
            got = {r["query_id"]: (r["n_combined"], r["n_to_combine"], [x["id"] for x in r["neighbors"]]) for r in out}
        q.stop()
    assert got == {1: (1, 2, [7]), 2: (1, 1, [8]), 3: (1, 1, []), 4: (1, 1, [])}


def test_lsh_curve_ranges(spark):
    """Rows go by the ranges of the period before; queries ask all that could have routed what they see."""
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(300)], "id long, v array<double>")
    cells = partitioners.lsh_cells(rows, 2, 2, 8, 0.5, F.floor(F.col("id") / 100))
    ranges = partitioners.lsh_ranges(cells, 4)
    heads = {(x["family"], x["period"]): x["heads"] for x in ranges.collect()}
    keys = {x["id"]: (x["period"], x["cells"]) for x in cells.collect()}
    for p in range(3):
        for f in range(2):
            mine = sorted(c[f] for q, c in keys.values() if q == p)
            assert heads[f, p + 1] == sorted({mine[100 * i // 4] for i in range(1, 4)})
    for fresh in (1, 2):
        got = {x["id"]: x["partitions"] for x in partitioners.by_lsh_ranges(cells, ranges, 2, fresh).collect()}
        for i, (p, c) in keys.items():
            tables = lambda f: [heads[f, q] for q in range(max(1, p - fresh + 1), p + 1)] or [[]]
            assert got[i] == sorted({sum(h <= c[f] for h in t) for f in range(2) for t in tables(f)})


def test_fitted_centroids(spark):
    """Nine points in three clusters: each gets a centroid."""
    points = [(x + dx, y + dy) for x, y in ((0, 0), (10, 0), (0, 10)) for dx, dy in ((0, 0), (1, 0), (0, 1))]
    rows = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(points)], "id long, v array<double>")
    centroids = partitioners.fit_centroids(rows, 3)
    to = {r["id"]: r["partitions"][0] for r in partitioners.by_centroids(rows, centroids, 2).collect()}
    assert len(centroids) == 3 and sum((np.array(points[i]) - centroids[p]) @ (np.array(points[i]) - centroids[p]) for i, p in to.items()) <= sum((np.array(points[i]) - centroids[q]) @ (np.array(points[i]) - centroids[q]) for i in to for q in range(3)) / 3
    assert partitioners.fit_centroids(rows.limit(0), 3) == []


def test_time_bounds_are_pushed_to_the_scan(spark):
    """What no query can see is filtered by the Parquet reader."""
    scratch = Scratch(spark, "pushed")
    rows = scratch.keep(spark.createDataFrame([(i, [float(i)], i * 10) for i in range(50)], "id long, v array<double>, event_time long"), "rows")
    q = spark.createDataFrame([(1, [3.0], 200, 50), (2, [9.0], 300, 120)], "query_id long, v array<double>, event_time long, ttl long")
    found = knn.nearest(rows, q, 3, time_filter="ge")
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_time,150)" in plan and "LessThanOrEqual(event_time,300)" in plan
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(1, 15), (1, 16), (1, 17), (2, 18), (2, 19), (2, 20)}
    first = knn.nearest(rows, q, 50, time_filter="ge", scope="batch_ttl").where("query_id = 2").select("id").collect()
    assert sorted(r["id"] for r in first) == list(range(25, 31))


def test_an_index_without_deletions_refuses_them(spark):
    log = spark.createDataFrame([("I", 1), ("I", 2)], "op string, id long")
    assert changelog.without_deletes(log).count() == 2
    with pytest.raises(Exception, match="takes no deletions"):
        changelog.without_deletes(log.unionByName(spark.createDataFrame([("D", 1)], "op string, id long"))).collect()


def test_index_exact_search_finds_what_walks_miss(spark):
    """More vectors than a beam holds, in norms that cosines do not tell apart, most of them twice: the k first by distance and id."""
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(600, 24)), 2, axis=0) * r.choice([1.0, 1.5], size=1200)[:, None]
    x[1::2][:500] = x[::2][:500]
    path = f"{Scratch(spark, 'index').dir}/v"
    vector_index.create(spark, path, shards=2, width=16)
    rows = [("I", i, x[i].tolist(), 1, i) for i in range(1200)]
    for part in (rows[:900], rows[900:], [("D", i, None, 2, 1500) for i in range(0, 1200, 9)]):
        vector_index.upsert(spark, path, spark.createDataFrame(part, "op string, id long, v array<double>, version long, event_time long"))
    times = [(5000, 9000), (1400, 1400), (700, 40), (1100, 300)]
    asked = [(n, x[(n * 37) % 1200].tolist(), *times[n % 4]) for n in range(40)]
    found = vector_index.search(spark, path, spark.createDataFrame(asked, "query_id long, v array<double>, event_time long, ttl long"), 7, exact=True)
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["id"])
    for n, v, t, ttl in asked:
        seen = [i for i in range(1200) if max(0, t - ttl) <= i <= t and (i % 9 or t < 1500)]
        dist = {i: vector_index.exactly("l2", np.array([v]), x[[i]])[0] for i in seen}
        assert got.get(n, []) == sorted(seen, key=lambda i: (dist[i], i))[:7], n


def test_index_search_of_few_visible_vectors_takes_no_wide_walk(spark, monkeypatch):
    """Where a query sees a small part of a graph, what it sees is compared: no walk widens up to the whole graph."""
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 8))
    g = Graph(vector_index._unit(x), np.arange(3000))
    x, ids, widths = x[g.order], np.arange(3000)[g.order], []
    monkeypatch.setattr(g, "beam", lambda q, start, layer, width, limit, f=g.beam: (widths.append(width), f(q, start, layer, width, limit))[1])
    found = list(vector_index._walked(g, x, ids, x[:20], 5, 16, lambda some: np.broadcast_to(ids % 600 == 0, (len(some), 3000)), False))
    assert sum(len(rows) for rows, *_ in found) == 100 and not widths


def test_all_pairs_without_a_join(spark):
    """Distances of all queries with all rows are made where the rows are; odd vectors give nulls."""
    r = np.random.default_rng(2)
    x = [v.tolist() for v in r.normal(size=(40, 5))] + [None, [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [], [float("nan")] * 5, [0.5] * 5]
    rows = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>").repartition(3)
    found = knn.all_pairs(rows, rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), "v"), 9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Cartesian" not in plan and "Exchange RoundRobin" in plan
    got = {(g["query_id"], g["id"]): g for g in found.collect()}
    assert len(got) == 24 * 47
    for (a, b), g in got.items():
        u, v = x[a], x[b]
        if u is None or v is None or len(u) != len(v) or None in u or None in v:
            assert [*g][2:] == [None] * 5
            continue
        l2, dot = float(knn.exact("l2", np.array([u]), np.array([v]))[0]), 1 - float(knn.exact("ip", np.array([u]), np.array([v]))[0])
        if math.isnan(dot):
            assert math.isnan(g["l2"]) and math.isnan(g["cosine"]) and g["l2_int"] is None
            continue
        assert abs(g["l2"] - l2) <= 6e-10 and abs(g["dot"] - dot) <= 6e-10 and abs(g["ip"] - 1 + dot) <= 6e-10
        assert g["l2_int"] == sum((math.floor(p * 100) - math.floor(q * 100)) ** 2 for p, q in zip(u, v))
        norm = math.sqrt(sum(p * p for p in u) * sum(q * q for q in v))
        assert g["cosine"] is None if norm == 0 else abs(g["cosine"] - 1 + dot / norm) <= 6e-10
    assert knn._half_up(np.array([0.5, -0.5, 1.5, 2.4]), 0).tolist() == [1.0, -1.0, 2.0, 2.0]


def test_release_gives_back_what_the_jvm_freed_outside_its_heap(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.io.File("/proc/self").getCanonicalFile().getName()

    def resident():
        with open(f"/proc/{pid}/status") as f:
            return next(int(x.split()[1]) // 1024 for x in f if x.startswith("VmRSS"))

    scratch = Scratch(spark, "release")
    scratch.release()
    held = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # about 0.1 MB each, outside the heap
    for x in held[:-1]:
        x.end()
    jvm.System.gc()
    before = resident()
    scratch.release()
    held[-1].end()
    assert before - resident() > 40


def test_each_shard_of_an_index_is_a_task_of_its_own(spark):
    path = f"{Scratch(spark, 'index').dir}/v"
    vector_index.create(spark, path, shards=16)
    x = np.random.default_rng(6).standard_normal((400, 4))
    vector_index.upsert(spark, path, spark.createDataFrame([("I", i, v.tolist(), 0, 0) for i, v in enumerate(x)], "op string, id long, v array<double>, version long, event_time long"))
    files = vector_index._stored(spark, path).select("shard", F.input_file_name().alias("file")).collect()
    assert len({r["file"] for r in files}) == len({r["shard"] for r in files}) == 16
    found = vector_index.search(spark, path, spark.createDataFrame([(0, x[7].tolist())], "query_id long, v array<double>"), 400, width=400)
    assert sorted(r["id"] for r in found.collect()) == list(range(400))


def test_a_graph_compares_new_nodes_with_all_while_it_is_small(monkeypatch):
    x = np.random.default_rng(8).standard_normal((6000, 16)).astype(np.float32)
    x[100:300] = x[0]  # equal scores
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, np.arange(6000))
    for limit in (1, 40, 64, 65, 2079, 2080, 6000):
        ids, score = g._compared(g.x[:50], limit)
        every = g.x[:50] @ g.x[:limit].T
        assert (np.sort(score, axis=1) == np.sort(every, axis=1)[:, -64:]).all()
        assert (np.take_along_axis(every, ids, axis=1) == score).all() and all(len(set(r)) == min(64, limit) for r in ids.tolist())
    recall = []
    for most in (1 << 15, 2000):  # then walks find the candidates
        monkeypatch.setattr("tidewater.operators.graph_index.COMPARED", most)
        g = Graph(x, np.arange(6000))
        score = g.nearest(g.x[300::20], 10, 128)[1]
        recall.append((score >= np.sort(g.x[300::20] @ g.x.T, axis=1)[:, -10:-9] - 1e-6).mean())
    assert min(recall) >= 0.95, recall


def test_release_collects_the_heaps_of_executors(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(session, "local", lambda spark: False)  # the driver's JVM is the executor here
    before = full()
    Scratch(spark, "heaps").release()
    assert full() >= before + 2  # the driver's own and a task's


def test_written_tables_have_no_more_files_than_they_are_worth(spark):
    rows = spark.range(0, 1000, 1, 211)
    few = session.files_for(rows)
    assert few == session.WAVES * session.slots(spark) < 211
    kept = Scratch(spark, "files", few).keep(rows, "rows")
    assert len(kept.inputFiles()) == few and kept.agg({"id": "sum"}).first()[0] == 499500
    assert len(Scratch(spark, "files").keep(rows, "rows").inputFiles()) == 211
    big = spark.range(0, 100 * session.FILE_BYTES, 1, 4)  # eight bytes a row
    assert session.files_for(big) == 800


def test_a_worker_keeps_what_one_kind_of_task_needs(monkeypatch):
    monkeypatch.setattr(session, "_kept", {})
    one = session.kept("a", lambda: [1])
    assert session.kept("a", list) is one and session.kept("b", list) == [] and list(session._kept) == ["b"]
