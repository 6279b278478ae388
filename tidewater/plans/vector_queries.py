"""Registered vector queries over `embeddings`, each with its SQL.

Queries are the rows whose id is divisible by 20, against all rows. Mutations are made from the table
by rule: row i is inserted at i * 1000 ms; ids of remainder 2 by 7 are written again, times 1.5, 20 s
later; ids of remainder 3 by 10 are deleted 50 s after their insertion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import curves, distance, lsh
from tidewater.functions.draws import draw_sql
from tidewater.operators import changelog, knn, partitioners
from tidewater.plans import curve_sql
from tidewater.session import table

K, DIM, PARTS = 10, 64, 8
FAMILIES, HASHES, WIDTH = 3, 2, 4.0
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, v, event_time, ttl of the stated queries."""
    return vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), "v", (F.col("id") * 1000 + 100000).alias("event_time"), F.lit(200000).cast("bigint").alias("ttl"))


def mutations(spark: SparkSession, sf: str) -> DataFrame:
    """op, id, v, event_time, seq."""
    v = vectors(spark, sf)
    kinds = F.array(
        F.struct(F.lit("I").alias("op"), F.lit(1.0).alias("s"), F.lit(0).alias("late"), F.lit(0).alias("n")),
        F.when(F.col("id") % 7 == 2, F.struct(F.lit("I").alias("op"), F.lit(1.5).alias("s"), F.lit(20000).alias("late"), F.lit(1).alias("n"))),
        F.when(F.col("id") % 10 == 3, F.struct(F.lit("D").alias("op"), F.lit(1.0).alias("s"), F.lit(50000).alias("late"), F.lit(2).alias("n"))),
    )
    each = v.select("id", "v", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("m"))
    value = F.when(F.col("m.op") == "I", F.transform("v", lambda x: x.cast("double") * F.col("m.s")))
    return each.select("m.op", "id", value.alias("v"), (F.col("id") * 1000 + F.col("m.late")).alias("event_time"), (F.col("id") * 10 + F.col("m.n")).alias("seq"))


def _dist(a: str, b: str, metric: str = "l2") -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    if metric == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
    return f"1.0 - {dot(a, b)}" if metric == "ip" else f"1.0 - {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})" if metric == "cosine" else dot(a, b)


ASKED = "q AS (SELECT vec_id query_id, embedding v, vec_id * 1000 + 100000 event_time, 200000 ttl FROM embeddings WHERE vec_id % 20 = 0)"
MUTATIONS = """m AS (SELECT 'I' op, vec_id id, list_transform(embedding, lambda x: x::DOUBLE) v, vec_id * 1000 event_time, vec_id * 10 seq FROM embeddings
 UNION ALL SELECT 'I', vec_id, list_transform(embedding, lambda x: x::DOUBLE * 1.5::DOUBLE), vec_id * 1000 + 20000, vec_id * 10 + 1 FROM embeddings WHERE vec_id % 7 = 2
 UNION ALL SELECT 'D', vec_id, NULL, vec_id * 1000 + 50000, vec_id * 10 + 2 FROM embeddings WHERE vec_id % 10 = 3)"""


def _top(pairs: str, k: int = K) -> str:
    return f"SELECT query_id, rank, id, round(dist, 9) dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) rank FROM ({pairs})) WHERE rank <= {k}"


def _knn_sql(metric: str = "l2", where: str = "true") -> str:
    return f"WITH {ASKED} " + _top(f"SELECT q.query_id, e.vec_id id, {_dist('q.v', 'e.embedding', metric)} dist FROM q, embeddings e WHERE {where}")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 9))


@query(_knn_sql())
def knn_l2(spark, sf):
    return _rounded(knn.nearest(vectors(spark, sf), asked(spark, sf), K))


@query(_knn_sql("ip"))
def knn_ip(spark, sf):
    return _rounded(knn.nearest(vectors(spark, sf), asked(spark, sf), K, "ip"))


@query(_knn_sql("cosine"))
def knn_cosine(spark, sf):
    return _rounded(knn.nearest(vectors(spark, sf), asked(spark, sf), K, "cosine"))


_COARSE = "list_transform({}, lambda x: floor(x::DOUBLE * 5))"


@query(f"WITH {ASKED} " + _top(f"SELECT q.query_id, e.vec_id id, {_dist(_COARSE.format('q.v'), _COARSE.format('e.embedding'))} dist FROM q, embeddings e"))
def knn_ties(spark, sf):
    """Vectors of small whole numbers, so that many rows are at one distance: ties go by id."""
    coarse = lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * 5).cast("double")))
    return _rounded(knn.nearest(coarse(vectors(spark, sf)), coarse(asked(spark, sf)), K))


@query(_knn_sql(where="e.label = 3"))
def knn_filter_label(spark, sf):
    return _rounded(knn.nearest(vectors(spark, sf).where("label = 3"), asked(spark, sf), K))


@query(_knn_sql(where="e.vec_id // 250 = (SELECT max(vec_id) // 250 FROM embeddings)"))
def knn_memonly(spark, sf):
    """Only the newest generation of rows (250 each), as when no flushed segment is searched."""
    v = vectors(spark, sf).withColumn("gen", F.floor(F.col("id") / 250))
    newest = v.agg(F.max("gen").alias("gen"))
    return _rounded(knn.nearest(v.join(F.broadcast(newest), "gen", "left_semi"), asked(spark, sf), K))


@query(f"WITH p AS (SELECT a.vec_id query_id, b.vec_id id, a.embedding x, b.embedding y FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT query_id, id, round({_dist('x', 'y')}, 9) l2, round({_dist('x', 'y', 'ip')}, 9) ip, round({_dist('x', 'y', 'cosine')}, 9) cosine, round({_dist('x', 'y', 'dot')}, 9) dot, list_sum(list_transform(list_zip(x, y), lambda p: (floor(p[1]::DOUBLE * 100)::BIGINT - floor(p[2]::DOUBLE * 100)::BIGINT) * (floor(p[1]::DOUBLE * 100)::BIGINT - floor(p[2]::DOUBLE * 100)::BIGINT)))::BIGINT l2_int FROM p")
def distance_pairs(spark, sf):
    """All metrics of the stated queries against all rows (a stated query set: a twentieth of the ids)."""
    v = vectors(spark, sf)
    return knn.all_pairs(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 9)


@query("SELECT min(list_min(embedding))::DOUBLE low, max(list_max(embedding))::DOUBLE high, max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE span, (max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE) * 8 / 200 width FROM embeddings")
def dataset_span(spark, sf):
    low, high = F.min(F.array_min("v")).cast("double"), F.max(F.array_max("v")).cast("double")
    return vectors(spark, sf).agg(low.alias("low"), high.alias("high"), (high - low).alias("span"), ((high - low) * 8 / 200).alias("width"))


LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) r FROM m) WHERE r = 1)"


@query(f"WITH {MUTATIONS}, {LATEST} SELECT id, op, event_time, seq FROM l")
def latest_vectors(spark, sf):
    return changelog.latest(mutations(spark, sf).select("id", "op", "event_time", "seq"), "id", "seq").select("id", "op", "event_time", "seq")


@query(f"WITH {MUTATIONS}, {LATEST} SELECT id, event_time, seq FROM l WHERE op <> 'D'")
def live_vectors(spark, sf):
    return changelog.live(mutations(spark, sf).select("id", "op", "event_time", "seq"), "id", "seq").select("id", "event_time", "seq")


@query(f"WITH {MUTATIONS} SELECT id, seq, event_time valid_from, lead(event_time) OVER (PARTITION BY id ORDER BY event_time, seq) valid_to FROM m")
def version_intervals(spark, sf):
    return changelog.intervals(mutations(spark, sf).drop("v")).select("id", "seq", F.col("event_time").alias("valid_from"), "valid_to")


@query(f"WITH {MUTATIONS} SELECT op, id, event_time FROM (SELECT *, max(CASE WHEN op = 'D' THEN event_time END) OVER (PARTITION BY id) kill FROM m) WHERE (op = 'I' AND (kill IS NULL OR kill <= event_time)) OR (op = 'D' AND event_time = kill)")
def buffered_mutations(spark, sf):
    return changelog.buffered(mutations(spark, sf).select("op", "id", "event_time"))


@query("SELECT vec_id id, 'I' op FROM embeddings")
def insert_stream(spark, sf):
    """delete_injection without deletes: every row an insert."""
    return changelog.inject_deletes(vectors(spark, sf).select("id"), 0)


@query(f"SELECT vec_id id, 'I' op FROM embeddings UNION ALL SELECT vec_id, 'D' FROM embeddings WHERE {draw_sql("'66:' || vec_id", 1000)} < 100")
def delete_injection(spark, sf):
    """A tenth of the ids deleted by a seeded hash."""
    return changelog.inject_deletes(vectors(spark, sf).select("id"), 100)


@query("SELECT vec_id id, CASE WHEN vec_id < 100 THEN vec_id * 1000000 WHEN vec_id < 300 THEN 100 * 1000000 + (vec_id - 100) * 10000000 ELSE 100 * 1000000 + 200 * 10000000 + (vec_id - 300) * 2000000000 END // 1000000 event_time FROM embeddings")
def stage_clock(spark, sf):
    """Event times at 1,000 rows a second, then 100 from row 100, then 2 s between rows from row 300."""
    return changelog.stage_clock(vectors(spark, sf).select("id"), [0, 100, 300], [1000, 100, -2], "id")


INTERVALS = f"WITH {ASKED}, {MUTATIONS}, i AS (SELECT *, lead(event_time) OVER (PARTITION BY id ORDER BY event_time, seq) valid_to FROM m)"


def _timed_sql(bound: str, extra: str = "") -> str:
    return f"{INTERVALS}{extra} " + _top(f"SELECT q.query_id, i.id, {_dist('q.v', 'i.v')} dist FROM q JOIN i ON i.op = 'I' AND i.event_time <= q.event_time AND (i.valid_to IS NULL OR q.event_time < i.valid_to) AND {bound}")


def _timed(spark, sf, **how) -> DataFrame:
    versions = changelog.intervals(mutations(spark, sf)).where("op = 'I'")
    return _rounded(knn.nearest(versions, asked(spark, sf), K, **how))


@query(_timed_sql("i.event_time >= greatest(0, q.event_time - q.ttl)"))
def knn_ttl(spark, sf):
    return _timed(spark, sf, time_filter="ge")


@query(_timed_sql("i.event_time > greatest(0, q.event_time - q.ttl)"))
def knn_ttl_strict(spark, sf):
    return _timed(spark, sf, time_filter="gt")


@query(_timed_sql("i.event_time > greatest(0, f.t - f.ttl)", ", f AS (SELECT event_time t, ttl FROM q ORDER BY event_time, query_id LIMIT 1)").replace("FROM q JOIN i", "FROM f, q JOIN i"))
def knn_ttl_batch_first(spark, sf):
    return _timed(spark, sf, time_filter="gt", scope="batch_first")


@query(_timed_sql("i.event_time >= greatest(0, q.event_time - f.ttl)", ", f AS (SELECT ttl FROM q ORDER BY event_time, query_id LIMIT 1)").replace("FROM q JOIN i", "FROM f, q JOIN i"))
def knn_ttl_batch_ttl(spark, sf):
    """The first query's time to live for all, each query's own time."""
    q = asked(spark, sf).withColumn("ttl", F.when(F.col("query_id") == 0, 200000).otherwise(F.col("query_id") * 10).cast("bigint"))
    return _rounded(knn.nearest(changelog.intervals(mutations(spark, sf)).where("op = 'I'"), q, K, time_filter="ge", scope="batch_ttl"))


@query(f"WITH {ASKED}, f AS (SELECT event_time t, ttl FROM q ORDER BY event_time, query_id LIMIT 1) " + _top(f"SELECT q.query_id, e.vec_id id, {_dist('q.v', 'e.embedding')} dist FROM f, q JOIN embeddings e ON e.vec_id * 1000 <= q.event_time AND e.vec_id * 1000 > greatest(0, f.t - f.ttl)"))
def knn_ttl_joint(spark, sf):
    """Insert and search in one function: strict bound of the first query; a deletion among the rows is an error."""
    rows = vectors(spark, sf).select("id", "v", (F.col("id") * 1000).alias("event_time"), F.lit("I").alias("op"))
    return _rounded(knn.nearest(changelog.without_deletes(rows), asked(spark, sf), K, time_filter="gt", scope="batch_first"))


@query(_timed_sql("true"))
def knn_asof_deletes(spark, sf):
    v = changelog.intervals(mutations(spark, sf)).where("op = 'I'")
    q = asked(spark, sf).withColumn("ttl", F.lit(knn.FOREVER))
    return _rounded(knn.nearest(v, q, K, time_filter="ge"))


# Routing


@query(f"WITH {ASKED}, {MUTATIONS}, {LATEST} " + _top(f"SELECT q.query_id, l.id, {_dist('q.v', 'l.v')} dist FROM q, l WHERE l.op = 'I'"))
def knn_latest(spark, sf):
    """No time filter: the newest version of every live id."""
    return _rounded(knn.nearest(changelog.live(mutations(spark, sf), "id", "seq"), asked(spark, sf), K))


def _simple(spark, sf):
    return partitioners.routed(vectors(spark, sf), partitioners.simple(F.col("id"), PARTS), PARTS)


SIMPLE = f"s AS (SELECT vec_id id, embedding v, {draw_sql('vec_id', PARTS)}::INT partition_id FROM embeddings)"


@query(f"WITH {SIMPLE} SELECT id, partition_id FROM s")
def route_simple(spark, sf):
    return _simple(spark, sf).select("id", "partition_id")


def _partials(spark, sf):
    q = partitioners.routed(asked(spark, sf), partitioners.every(PARTS), PARTS, query=True)
    return partitioners.search(_simple(spark, sf), q, K)


@query(_knn_sql())
def knn_partitioned_simple(spark, sf):
    return _rounded(partitioners.ranked(partitioners.merged(_partials(spark, sf), K)))


_MERGED = "SELECT p.query_id, {n} n_combined, {all} n_to_combine, {n} = {all} complete, list(p.id ORDER BY p.rank) ids FROM ({top}) p GROUP BY 1"


@query(_MERGED.format(n=PARTS, all=PARTS, top=_knn_sql()))
def merge_partials(spark, sf):
    ids = F.transform("neighbors", lambda x: x["id"]).alias("ids")
    return partitioners.merged(_partials(spark, sf), K).select("query_id", "n_combined", "n_to_combine", "complete", ids)


@query(_MERGED.format(n=PARTS - 1, all=PARTS, top=f"WITH {SIMPLE} " + _top(f"SELECT q.id query_id, s.id, {_dist('q.v', 's.v')} dist FROM s q, s WHERE q.id % 20 = 0 AND s.partition_id <> 3")))
def incomplete_queries(spark, sf):
    """Queries whose partial result of one partition is missing: what the others found, marked as not complete."""
    m = partitioners.merged(_partials(spark, sf).where("partition_id <> 3"), K)
    return m.select("query_id", "n_combined", "n_to_combine", "complete", F.transform("neighbors", lambda x: x["id"]).alias("ids"))


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY id) r, count(*) OVER (PARTITION BY partition_id) c FROM s)"


@query(f"WITH {SIMPLE}, {_NUMBERED} SELECT query_id, partition_id, rank, id, round(dist, 9) dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id, partition_id ORDER BY dist, id) rank FROM (SELECT q.id query_id, n.partition_id, n.id, {_dist('q.v', 'n.v')} dist FROM s q, n WHERE q.id % 20 = 0 AND n.r <= n.c // 20 * 20)) WHERE rank <= {K}")
def knn_buffered(spark, sf):
    """An index that is fed 20 rows at a time: rows still in the buffer are not seen, partial results stay apart."""
    rows = partitioners.flushed(_simple(spark, sf), 20, "id")
    q = partitioners.routed(asked(spark, sf), partitioners.every(PARTS), PARTS, query=True)
    each = partitioners.search(rows, q, K).select("query_id", "partition_id", F.posexplode("neighbors").alias("p", "x"))
    return each.select("query_id", "partition_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), F.round("x.dist", 9).alias("dist"))


@query(f"WITH {SIMPLE} SELECT id FROM s WHERE partition_id = 3")
def partition_dump(spark, sf):
    """The ids that a partition holds."""
    return _simple(spark, sf).where("partition_id = 3").select("id")


@query(f"WITH {MUTATIONS} SELECT 'data' side, op, id, event_time FROM m UNION ALL SELECT 'query', 'Q', vec_id, vec_id * 1000 + 100000 FROM embeddings WHERE vec_id % 20 = 0")
def split_streams(spark, sf):
    """One stream of mutations and queries taken apart by type."""
    q = asked(spark, sf).select(F.lit("Q").alias("op"), F.col("query_id").alias("id"), "event_time")
    data, queries = partitioners.split(mutations(spark, sf).select("op", "id", "event_time").unionByName(q))
    return data.withColumn("side", F.lit("data")).unionByName(queries.withColumn("side", F.lit("query")))


@query(f"WITH {SIMPLE}, c AS (SELECT id // 100 \"window\", partition_id, count(*) n FROM s GROUP BY 1, 2) SELECT \"window\", count(*) partitions, sum(n)::BIGINT n_rows, max(n) largest, round((max(n) - avg(n)) / avg(n), 9) imbalance FROM c GROUP BY 1")
def partition_balance(spark, sf):
    """Imbalance of each window of 100 records."""
    return partitioners.balance(_simple(spark, sf), F.floor(F.col("id") / 100)).withColumn("imbalance", F.round("imbalance", 9))


@query(f"WITH {SIMPLE} SELECT partition_id, count(*) n FROM s GROUP BY 1")
def partition_histogram(spark, sf):
    return _simple(spark, sf).groupBy("partition_id").agg(F.count("*").alias("n"))


# LSH


def _hash_sql(family: int, v: str = "embedding") -> str:
    one = lambda j: f"floor(({_dist(v, str(lsh.coefficients(family, j, DIM)), 'dot')} + {lsh.offset(family, j, DIM, WIDTH)}::DOUBLE) / {WIDTH}::DOUBLE)::BIGINT"
    return "[" + ", ".join(one(j) for j in range(HASHES)) + "]"


def _bucket_sql(h: str) -> str:
    h1 = f"(31 + {h}[1])"
    return f"((({h1} * 31 + {h}[2]) % {PARTS} + {PARTS}) % {PARTS})::INT"


HASHED = "h AS (SELECT vec_id id, embedding v, " + ", ".join(f"{_hash_sql(f)} h{f}" for f in range(FAMILIES)) + " FROM embeddings)"
BUCKETS = f"{HASHED}, b AS (SELECT id, v, h0, h1, h2, list_sort(list_distinct([{', '.join(_bucket_sql(f'h{f}') for f in range(FAMILIES))}])) parts FROM h)"


def _lsh(v="v"):
    return partitioners.by_lsh(F.col(v), PARTS, FAMILIES, HASHES, DIM, WIDTH)


@query(f"WITH {HASHED} SELECT id, family, h[1] a, h[2] b FROM (SELECT id, 0 family, h0 h FROM h UNION ALL SELECT id, 1, h1 FROM h UNION ALL SELECT id, 2, h2 FROM h)")
def lsh_hash(spark, sf):
    per = [F.struct(F.lit(f).alias("family"), lsh.hashes(F.col("v"), f, HASHES, DIM, WIDTH).alias("h")) for f in range(FAMILIES)]
    return vectors(spark, sf).select("id", F.explode(F.array(*per)).alias("x")).select("id", "x.family", F.col("x.h")[0].alias("a"), F.col("x.h")[1].alias("b"))


@query(f"WITH {BUCKETS} SELECT id, unnest(parts) partition_id FROM b")
def lsh_buckets(spark, sf):
    return partitioners.routed(vectors(spark, sf), _lsh(), PARTS).select("id", "partition_id")


def _lsh_search(spark, sf, to) -> DataFrame:
    rows = partitioners.routed(vectors(spark, sf), _lsh(), PARTS)
    q = partitioners.routed(asked(spark, sf), to, PARTS, query=True)
    return partitioners.ranked(partitioners.merged(partitioners.search(rows, q, K), K))


LSH_PAIRS = f"SELECT q.id query_id, b.id, {_dist('q.v', 'b.v')} dist FROM b q JOIN b ON list_has_any(q.parts, b.parts) WHERE q.id % 20 = 0"


@query(f"WITH {BUCKETS} " + _top(LSH_PAIRS))
def knn_lsh(spark, sf):
    return _rounded(_lsh_search(spark, sf, _lsh()))


_NEAR = "[" + ", ".join(_bucket_sql(f"[h{f}[1] + ({i}), h{f}[2] + ({j})]") for f in range(FAMILIES) for i in (-1, 0, 1) for j in (-1, 0, 1)) + "]"


@query(f"WITH {BUCKETS}, p AS (SELECT id, v, {_NEAR} parts FROM b WHERE id % 20 = 0) " + _top(f"SELECT q.id query_id, b.id, {_dist('q.v', 'b.v')} dist FROM p q JOIN b ON list_has_any(q.parts, b.parts)"))
def knn_lsh_proximity(spark, sf):
    return _rounded(_lsh_search(spark, sf, partitioners.by_lsh_near(F.col("v"), PARTS, FAMILIES, HASHES, DIM, WIDTH, 1)))


_DRAWN = "[" + ", ".join(f"""{draw_sql(f"'23456789:{i}:' || id", PARTS)}::INT""" for i in range(PARTS // 3)) + "]"


@query(f"WITH {BUCKETS}, p AS (SELECT id, v, list_concat(parts, {_DRAWN}) parts FROM b WHERE id % 20 = 0) " + _top(f"SELECT q.id query_id, b.id, {_dist('q.v', 'b.v')} dist FROM p q JOIN b ON list_has_any(q.parts, b.parts)"))
def knn_lsh_random(spark, sf):
    return _rounded(_lsh_search(spark, sf, partitioners.by_lsh_random(F.col("v"), F.col("query_id"), PARTS, FAMILIES, HASHES, DIM, WIDTH)))


@query(f"WITH {BUCKETS}, f AS ({_top(LSH_PAIRS)}), t AS (" + _top(f"SELECT q.id query_id, b.id, {_dist('q.v', 'b.v')} dist FROM b q, b WHERE q.id % 20 = 0") + ") SELECT f.query_id, count(*) n_found, count(t.id) n_hit, count(t.id) / count(*) recall FROM f LEFT JOIN t ON f.query_id = t.query_id AND f.id = t.id GROUP BY f.query_id")
def recall_lsh(spark, sf):
    return knn.recall(_lsh_search(spark, sf, _lsh()), knn_l2(spark, sf))


@query(f"WITH {BUCKETS} SELECT id query_id, len(parts)::INT n_to_combine, CASE WHEN len(parts) > 1 THEN list_max(parts) * 5 + 1 ELSE 0 END::BIGINT latency FROM b WHERE id % 20 = 0")
def query_latency(spark, sf):
    """Time from a query to its last partial result, where partition p answers after 5 p + 1 ms; 0 if there is but one."""
    sent = partitioners.routed(asked(spark, sf), _lsh(), PARTS, query=True)
    return partitioners.latency(sent.withColumn("answered", F.col("event_time") + F.col("partition_id") * 5 + 1))


# LSH cells on a curve, with ranges that follow the data

CURVE_HASHES, CURVE_WIDTH, PERIOD = 4, 0.5, 100
_GRID = 8


def _grid_sql(family: int) -> str:
    one = lambda j: f"greatest(0, least(15, floor(({_dist('v', str(lsh.coefficients(family, j, DIM)), 'dot')} + {lsh.offset(family, j, DIM, CURVE_WIDTH)}::DOUBLE) / {CURVE_WIDTH}::DOUBLE)::BIGINT + {_GRID}))"
    return "[" + ", ".join(one(j) for j in range(CURVE_HASHES)) + "]"


def _lsh_curve_ctes() -> str:
    """x(id, v, period, family, key), t(family, period, heads), of all rows."""
    source = "SELECT vec_id id, embedding v FROM embeddings"
    each = " UNION ALL ".join(f"SELECT id, {f} family, key FROM ({curve_sql.number(curve_sql.hilbert(f'SELECT id, {_grid_sql(f)} c FROM ({source})', CURVE_HASHES, 4), 2)})" for f in range(FAMILIES))
    return (
        f"x AS MATERIALIZED (SELECT k.*, id // {PERIOD} period FROM ({each}) k), o AS (SELECT *, row_number() OVER (PARTITION BY family, period ORDER BY key) - 1 n, count(*) OVER (PARTITION BY family, period) c FROM x), "
        f"t AS (SELECT family, period + 1 period, list_sort(list(DISTINCT key)) heads FROM o, range(1, {PARTS}) r(i) WHERE n = c * i // {PARTS} GROUP BY 1, 2)"
    )


def _lsh_routes_sql(fresh: int) -> str:
    """SELECT id, partition_id of all rows."""
    return f"SELECT DISTINCT x.id, coalesce(len(list_filter(t.heads, lambda h: h <= x.key)), 0)::INT partition_id FROM x LEFT JOIN t ON t.family = x.family AND t.period <= x.period AND t.period > x.period - {fresh}"


def _lsh_curve(spark, sf, fresh: int):
    v = partitioners.lsh_cells(vectors(spark, sf), FAMILIES, CURVE_HASHES, DIM, CURVE_WIDTH, F.floor(F.col("id") / PERIOD))
    return partitioners.by_lsh_ranges(v, partitioners.lsh_ranges(v, PARTS), FAMILIES, fresh)


@query(f"WITH {_lsh_curve_ctes()} {_lsh_routes_sql(1)}")
def route_lsh_hilbert(spark, sf):
    """Each row's partitions: per family, hash -> grid -> Hilbert key -> range of the hundred rows before."""
    return partitioners.routed(_lsh_curve(spark, sf, 1), F.col("partitions"), PARTS).select("id", "partition_id")


def _lsh_hilbert_search(spark, sf):
    rows = partitioners.routed(_lsh_curve(spark, sf, 1), F.col("partitions"), PARTS)
    q = _lsh_curve(spark, sf, 2).where("id % 20 = 0").withColumnRenamed("id", "query_id")
    sent = partitioners.routed(q, F.col("partitions"), PARTS, query=True)
    return partitioners.ranked(partitioners.merged(partitioners.search(rows, sent, K), K))


_LSH_HILBERT = f"WITH {_lsh_curve_ctes()}, d AS ({_lsh_routes_sql(1)}), a AS ({_lsh_routes_sql(2)}), p AS (SELECT DISTINCT a.id query_id, d.id FROM a JOIN d ON a.partition_id = d.partition_id WHERE a.id % 20 = 0) "
_LSH_HILBERT_TOP = _top(f"SELECT p.query_id, p.id, {_dist('q.embedding', 'e.embedding')} dist FROM p JOIN embeddings q ON q.vec_id = p.query_id JOIN embeddings e ON e.vec_id = p.id")


@query(_LSH_HILBERT + _LSH_HILBERT_TOP)
def knn_lsh_hilbert(spark, sf):
    """Search of the partitions that a query's two latest range tables name."""
    return _rounded(_lsh_hilbert_search(spark, sf))


@query(_LSH_HILBERT + f", found AS ({_LSH_HILBERT_TOP}), truth AS (" + _top(f"SELECT q.vec_id query_id, e.vec_id id, {_dist('q.embedding', 'e.embedding')} dist FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0") + ") SELECT found.query_id, count(*) n_found, count(truth.id) n_hit, count(truth.id) / count(*) recall FROM found LEFT JOIN truth ON found.query_id = truth.query_id AND found.id = truth.id GROUP BY found.query_id")
def recall_lsh_hilbert(spark, sf):
    return knn.recall(_lsh_hilbert_search(spark, sf), knn_l2(spark, sf))


# Curves over all components

BITS, LOW, HIGH = 4, -0.5, 0.5


def _cells(bits: int = BITS) -> object:
    return curves.quantize(F.col("v"), LOW, HIGH, bits)


def _cells_sql(bits: int = BITS) -> str:
    return f"SELECT vec_id id, list_transform(embedding, lambda x: least(floor(greatest(0, least(1, (x::DOUBLE - ({LOW})) / {HIGH - LOW})) * {2**bits}), {2**bits - 1})::BIGINT) c FROM embeddings"


def _keyed(spark, sf, curve: str):
    """(id, key): the digits of the key as text, which sorts as the number does."""
    return vectors(spark, sf).select("id", curves.key(curve, _cells(), DIM, BITS).cast("string").alias("key"))


@query(_cells_sql())
def quantize_grid(spark, sf):
    return vectors(spark, sf).select("id", _cells().alias("c"))


@query(curve_sql.text(curve_sql.zorder(_cells_sql(), DIM, BITS)))
def zorder_key(spark, sf):
    return _keyed(spark, sf, "zorder")


@query(curve_sql.text(curve_sql.gray(_cells_sql(), DIM, BITS)))
def gray_key(spark, sf):
    return _keyed(spark, sf, "gray")


@query(curve_sql.text(curve_sql.hilbert(_cells_sql(), DIM, BITS)))
def hilbert_key(spark, sf):
    return _keyed(spark, sf, "hilbert")


_THIRDS = f"SELECT id, list_transform(c, lambda x: least(x, 8)) c FROM ({_cells_sql()})"


@query(curve_sql.text(curve_sql.peano(_THIRDS, DIM, 2)))
def peano_key(spark, sf):
    c = F.transform(_cells(), lambda x: F.least(x, F.lit(8)))
    return vectors(spark, sf).select("id", curves.key("peano", c, DIM, 2).cast("string").alias("key"))


def _ranges_sql(keys: str) -> str:
    """k(id, key), e(key): heads, p(id, partition_id)."""
    return f"k AS MATERIALIZED ({keys}), s AS (SELECT key, row_number() OVER (ORDER BY key) - 1 n, count(*) OVER () t FROM k), e AS (SELECT DISTINCT s.key FROM s, range(1, {PARTS}) r(i) WHERE s.n = s.t * r.i // {PARTS}), p AS (SELECT id, (SELECT count(*) FROM e WHERE e.key <= k.key)::INT partition_id FROM k)"


def _ranged(spark, sf, curve: str):
    keyed = _keyed(spark, sf, curve)
    return vectors(spark, sf).join(keyed, "id"), partitioners.heads(keyed, PARTS)


@query(f"WITH {_ranges_sql(curve_sql.text(curve_sql.zorder(_cells_sql(), DIM, BITS)))} SELECT * FROM p")
def route_curve(spark, sf):
    keyed = _keyed(spark, sf, "zorder")
    return keyed.select("id", partitioners.by_range(F.col("key"), partitioners.heads(keyed, PARTS))[0].alias("partition_id"))


_RING = f"WITH {_ranges_sql(curve_sql.text(curve_sql.hilbert(_cells_sql(), DIM, BITS)))}"


@query(f"{_RING} SELECT id, (partition_id + d + {PARTS}) % {PARTS} partition_id FROM p, (VALUES (0), (-1), (1)) r(d)")
def route_hilbert_ring(spark, sf):
    """The range of the Hilbert key of the whole vector, and its neighbours around the ring."""
    rows, edges = _ranged(spark, sf, "hilbert")
    return partitioners.routed(rows, partitioners.with_ring(partitioners.by_range(F.col("key"), edges), PARTS, 3), PARTS).select("id", "partition_id")


@query(f"{_RING} " + _top(f"SELECT q.id query_id, r.id, {_dist('a.embedding', 'b.embedding')} dist FROM p q JOIN p r ON (q.partition_id - r.partition_id + {PARTS}) % {PARTS} IN (0, 1, {PARTS - 1}) JOIN embeddings a ON a.vec_id = q.id JOIN embeddings b ON b.vec_id = r.id WHERE q.id % 20 = 0"))
def knn_curve(spark, sf):
    """Hilbert ranges of the whole vector; a query also asks the two neighbouring partitions."""
    rows, edges = _ranged(spark, sf, "hilbert")
    home = partitioners.by_range(F.col("key"), edges)
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    sent = partitioners.routed(q, partitioners.with_ring(home, PARTS, 3), PARTS, query=True)
    return _rounded(partitioners.ranked(partitioners.merged(partitioners.search(partitioners.routed(rows, home, PARTS), sent, K), K)))


# k-means and SAX


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) j FROM embeddings), c AS (SELECT label, list(round(a, 6) ORDER BY j) c FROM (SELECT label, j, avg(v) a FROM x GROUP BY 1, 2) GROUP BY 1), "
       f"d AS (SELECT vec_id id, c.label, row_number() OVER (PARTITION BY vec_id ORDER BY {_dist('embedding', 'c.c')}, c.label) r FROM embeddings, c) SELECT id, label::INT partition_id FROM d WHERE r <= 2")
def kmeans_route(spark, sf):
    """Centroids are the means of the labels; every row goes to its two nearest."""
    v = vectors(spark, sf)
    means = v.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.round(F.avg(F.col("col").cast("double")), 6).alias("a"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("c")).orderBy("label").collect()  # a row for each label
    centroids, names = [[x["a"] for x in r["c"]] for r in rows], F.array(*[F.lit(r["label"]) for r in rows])
    routed = partitioners.by_centroids(v, centroids, 2)
    return routed.select("id", F.explode("partitions").alias("p")).select("id", F.element_at(names, F.col("p") + 1).cast("int").alias("partition_id"))


CLUSTERS, ROUNDS, FIRST = 4, 3, 250


def _fit_sql() -> str:
    """f0 .. f<ROUNDS>(n, c): centroids after each round."""
    out = f"h AS (SELECT vec_id id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings WHERE vec_id < {FIRST}), f0 AS (SELECT row_number() OVER (ORDER BY {draw_sql('id')}, id) - 1 n, v c FROM h QUALIFY n < {CLUSTERS})"
    for i in range(ROUNDS):
        near = f"SELECT id, v, arg_min(n, (d, n)) n FROM (SELECT h.id, h.v, f{i}.n, {_dist('h.v', f'f{i}.c')} d FROM h, f{i}) GROUP BY id, v"
        out += f", f{i + 1} AS (SELECT n, list(a ORDER BY j) c FROM (SELECT n, j, round(avg(x), 9) a FROM (SELECT n, unnest(v) x, generate_subscripts(v, 1) j FROM ({near})) GROUP BY 1, 2) GROUP BY 1)"
    return out


@query(f"WITH {_fit_sql()} SELECT vec_id id, {draw_sql('vec_id', CLUSTERS)}::INT partition_id FROM embeddings WHERE vec_id < {FIRST} UNION ALL SELECT id, n::INT FROM (SELECT e.vec_id id, f.n, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_dist('e.embedding', 'f.c')}, f.n) r FROM embeddings e, f{ROUNDS} f WHERE e.vec_id >= {FIRST}) WHERE r <= 2")
def kmeans_window_route(spark, sf):
    """Rows go to the two nearest of the centroids fitted on the window before; before the first fit, to one by a draw."""
    v = vectors(spark, sf)
    old, new = v.where(f"id < {FIRST}"), v.where(f"id >= {FIRST}")
    centroids = partitioners.fit_centroids(old, CLUSTERS, ROUNDS)
    drawn = partitioners.routed(old, partitioners.simple(F.col("id"), CLUSTERS), CLUSTERS).select("id", "partition_id")
    return drawn.unionByName(partitioners.routed(partitioners.by_centroids(new, centroids, 2), F.col("partitions"), CLUSTERS).select("id", "partition_id"))


SEGMENTS, LETTER_BITS = 4, 2


def _sax_sql() -> str:
    mean = "list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64"
    power = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64"
    part = lambda j: f"list_sum(list_transform(embedding[{j * 16 + 1}:{j * 16 + 16}], lambda x: x::DOUBLE)) / 16"
    letter = lambda j: "(" + " + ".join(f"CASE WHEN (p{j} - mean) / dev > ({c}) THEN 1 ELSE 0 END" for c in lsh.cuts(LETTER_BITS)) + ")"
    base = f"p AS (SELECT vec_id id, {mean} mean, sqrt(greatest({power} - ({mean}) * ({mean}), 0)) dev, " + ", ".join(f"{part(j)} p{j}" for j in range(SEGMENTS)) + " FROM embeddings)"
    return f"{base}, w0 AS (SELECT id, ({letter(0)} * 64 + {letter(1)} * 16 + {letter(2)} * 4 + {letter(3)})::BIGINT w FROM p), w AS (SELECT id, xor(w, w >> 1) word FROM w0)"


@query(f"WITH {_sax_sql()} SELECT id, word FROM w")
def sax_word(spark, sf):
    return vectors(spark, sf).select("id", lsh.sax_word(F.col("v"), DIM, SEGMENTS, LETTER_BITS).alias("word"))


WINDOW = 100


@query(f"WITH {_sax_sql()}, n AS (SELECT id // {WINDOW} g, word, count(*) n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, word) r FROM n) SELECT g + 1 \"window\", word, n FROM r WHERE r <= 5")
def hot_words(spark, sf):
    return partitioners.hot(sax_word(spark, sf), F.floor(F.col("id") / WINDOW), 5)


_ODYSSEY = (
    f"n AS (SELECT id // {WINDOW} g, word, count(*) n FROM w GROUP BY 1, 2), hot AS (SELECT g + 1 g, word FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, word) r FROM n) WHERE r <= 5), "
    f"c AS (SELECT g + 1 g, home, n, sum(n) OVER (PARTITION BY g) / 4 mean FROM (SELECT id // {WINDOW} g, word % 4 home, count(*) n FROM w GROUP BY 1, 2)), heavy AS (SELECT g, home FROM c WHERE n > mean * 1.5), "
    f"grp AS (SELECT w.id, CASE WHEN hot.word IS NOT NULL OR heavy.home IS NOT NULL THEN {draw_sql('w.id', 4)} ELSE w.word % 4 END::INT grp FROM w LEFT JOIN hot ON hot.g = w.id // {WINDOW} AND hot.word = w.word LEFT JOIN heavy ON heavy.g = w.id // {WINDOW} AND heavy.home = w.word % 4)"
)


@query(f"WITH {_sax_sql()}, {_ODYSSEY} SELECT id, unnest([grp, grp + 4]) partition_id FROM grp")
def odyssey_route(spark, sf):
    """Rows of the words and groups that were hot in the window before are spread; all go to both replicas."""
    routed = partitioners.odyssey(sax_word(spark, sf), F.floor(F.col("id") / WINDOW), 4, 2, 5, skew=1.5)
    return routed.select("id", F.explode("partitions").alias("partition_id"))


@query(f"SELECT query_id, query_id || ' 0 ' || string_agg('(' || id || ',' || printf('%.9f', dist) || ')', ' ' ORDER BY rank) line FROM ({_knn_sql()}) GROUP BY query_id")
def result_lines(spark, sf):
    """Result files' lines, written as text and read back."""
    from tidewater.session import Scratch

    lines = Scratch(spark, "results").keep(knn.as_text(knn_l2(spark, sf), F.lit(0)).select("line"), "lines", "text")
    return lines.select(F.substring_index("line", " ", 1).cast("bigint").alias("query_id"), "line")
