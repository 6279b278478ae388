"""Registered key-value and access-log queries, each with its SQL.

The log is made from `events`: key user_id, sequence event_id; every eleventh row from the fifth is a
deletion, the others are puts of `value`. Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.draws import draw_sql
from tidewater.operators import changelog, kv, merge_operators, trace
from tidewater.session import Scratch, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, sf: str) -> DataFrame:
    """k, seq, ts, op, v, kind."""
    op = F.when(F.col("event_id") % 11 == 5, "DEL").otherwise("PUT")
    return table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), op.alias("op"), F.col("value").alias("v"), F.col("event_type").alias("kind"))


LOG = "log AS (SELECT user_id k, event_id seq, (epoch_us(ts) // 1000)::BIGINT ts, CASE WHEN event_id % 11 = 5 THEN 'DEL' ELSE 'PUT' END op, value v, event_type kind FROM events)"
NEWEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM log) WHERE r = 1), live AS (SELECT k, seq, ts, v, kind FROM latest WHERE op = 'PUT')"
MIDDLE = "(SELECT max(seq) // 2 FROM log)"


def live(spark, sf) -> DataFrame:
    return kv.view(log(spark, sf)).drop("op")


def _middle(spark, sf) -> int:
    return log(spark, sf).agg(F.floor(F.max("seq") / 2)).first()[0]


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, v FROM live")
def kv_latest(spark, sf):
    return live(spark, sf).select("k", "seq", "v")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, v FROM live WHERE k = 42")
def kv_get(spark, sf):
    return kv.view(log(spark, sf).where("k = 42")).select("k", "seq", "v")


@query(f"WITH {LOG} SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM log WHERE seq <= {MIDDLE}) WHERE r = 1 AND op = 'PUT'")
def kv_asof(spark, sf):
    """The view at the sequence half way through the log."""
    return kv.view(log(spark, sf), snapshot=F.lit(_middle(spark, sf))).select("k", "seq", "v")


@query(f"WITH {LOG} SELECT k, seq, ts, op, v FROM log WHERE ts BETWEEN (SELECT min(ts) + (max(ts) - min(ts)) // 4 FROM log) AND (SELECT min(ts) + (max(ts) - min(ts)) // 2 FROM log)")
def kv_history(spark, sf):
    rows = log(spark, sf)
    a, b = rows.agg(F.min("ts"), F.max("ts")).first()
    return kv.history(rows, F.lit(a + (b - a) // 4), F.lit(a + (b - a) // 2)).select("k", "seq", "ts", "op", "v")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def kv_scan_range(spark, sf):
    return kv.scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), low=1000, high=5000, key="o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC LIMIT 25")
def kv_reverse_scan(spark, sf):
    return kv.scan(table(spark, sf, "customer").select("c_custkey", "c_name"), key="c_name", reverse=True, limit=25)


@query("SELECT p_partkey, p_type, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def kv_prefix_scan(spark, sf):
    return kv.scan(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), prefix="Brand#1", key="p_brand")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 777 ORDER BY o_orderkey DESC LIMIT 1")
def kv_seek_for_prev(spark, sf):
    return kv.seek_for_prev(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 777, "o_orderkey")


@query(f"WITH {LOG}, {NEWEST} SELECT c.c_custkey k, live.seq, live.v FROM customer c LEFT JOIN live ON live.k = c.c_custkey")
def kv_multiget(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return kv.multi_get(live(spark, sf).select("k", "seq", "v"), keys)


@query("SELECT c_custkey k, c_custkey IN (SELECT user_id FROM events) found FROM customer")
def kv_may_exist(spark, sf):
    return kv.may_exist(log(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query(f"WITH {LOG}, {NEWEST}, r AS (SELECT k b, k + 3 e, seq s FROM log WHERE seq % 97 = 0) SELECT k, seq, v FROM live l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.k >= r.b AND l.k < r.e AND r.s > l.seq)")
def kv_range_delete(spark, sf):
    """Every 97th row also deletes the three keys from its own on."""
    rows = log(spark, sf)
    tombstones = rows.where("seq % 97 = 0").select(F.col("k").alias("b"), (F.col("k") + 3).alias("e"), "seq")
    return changelog.range_deleted(live(spark, sf), tombstones).select("k", "seq", "v")


@query(f"WITH {LOG} SELECT k, seq FROM (SELECT *, lead(CASE WHEN op = 'DEL' THEN 'SDEL' ELSE op END) OVER (PARTITION BY k ORDER BY seq) n FROM log) WHERE op = 'PUT' AND coalesce(n, '') <> 'SDEL'")
def kv_single_delete(spark, sf):
    rows = log(spark, sf).withColumn("op", F.when(F.col("op") == "DEL", "SDEL").otherwise(F.col("op")))
    return changelog.single_deleted(rows).select("k", "seq")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, ts FROM live WHERE (k % 5) * 86400000 <= 0 OR ts + (k % 5) * 86400000 >= (SELECT max(ts) FROM log)")
def kv_ttl(spark, sf):
    """Keys live k % 5 days; those of 0 for ever."""
    rows = live(spark, sf)
    now = log(spark, sf).agg(F.max("ts")).first()[0]
    return kv.unexpired(rows, F.lit(now), (F.col("k") % 5) * 86400000, F.col("ts")).select("k", "seq", "ts")


@query(f"WITH {LOG}, b AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM log WHERE seq <= {MIDDLE}) WHERE r = 1 AND op = 'PUT'), d AS (SELECT k, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM log WHERE seq > {MIDDLE}) WHERE r = 1) SELECT coalesce(b.k, d.k) k, CASE WHEN d.op IS NOT NULL THEN d.v ELSE b.v END v FROM b FULL JOIN d ON b.k = d.k WHERE coalesce(d.op, 'PUT') <> 'DEL'")
def kv_overlay(spark, sf):
    """The first half of the log as the base, the second as an indexed batch over it."""
    m = _middle(spark, sf)
    rows = log(spark, sf)
    base = kv.view(rows, snapshot=F.lit(m)).select("k", "v")
    delta = changelog.latest(rows.where(F.col("seq") > m), "k", "seq").select("k", "op", "v")
    return kv.overlay(base, delta)


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, CASE WHEN kind = 'click' THEN v * 2 ELSE v END v FROM live WHERE v > 0 AND k % 7 <> 0")
def kv_compaction_filter(spark, sf):
    keep = (F.col("v") > 0) & (F.col("k") % 7 != 0)
    return kv.compact(log(spark, sf), keep=keep, value=F.when(F.col("kind") == "click", F.col("v") * 2).otherwise(F.col("v"))).select("k", "seq", "v")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE length(c_mktsegment) > 0")
def kv_remove_empty_values(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").where(F.length("c_mktsegment") > 0)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 2500")
def kv_clip(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").where("o_orderkey >= 500 and o_orderkey < 2500")


@query(f"WITH {LOG} SELECT k, list(v ORDER BY seq) operands FROM log GROUP BY k")
def kv_merge_operands(spark, sf):
    return log(spark, sf).groupBy("k").agg(merge_operators.operands("v", "seq").alias("operands"))


@query("SELECT (o_orderkey >= 1000)::INT + (o_orderkey >= 3000)::INT + (o_orderkey >= 9000)::INT \"range\", count(*) n, sum(length(o_orderpriority) + 16)::BIGINT bytes FROM orders GROUP BY 1")
def kv_range_sizes(spark, sf):
    return kv.range_sizes(table(spark, sf, "orders"), [1000, 3000, 9000], F.length("o_orderpriority") + 16, "o_orderkey")


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log WHERE seq >= {MIDDLE}")
def kv_updates_since(spark, sf):
    return log(spark, sf).where(F.col("seq") >= _middle(spark, sf)).select("k", "seq", "op", "v")


@query(f"WITH {LOG} SELECT k, seq, v FROM log WHERE seq // 10 IN (SELECT seq // 10 FROM log WHERE kind = 'purchase')")
def kv_read_committed(spark, sf):
    """Ten rows are a transaction; a purchase in it is its commit mark."""
    rows = log(spark, sf).withColumn("txn", F.floor(F.col("seq") / 10))
    return kv.committed(rows, rows.where("kind = 'purchase'")).select("k", "seq", "v")


@query("SELECT substr(c_name, 1, 10) prefix, count(*) n FROM customer GROUP BY 1")
def slice_transform(spark, sf):
    return table(spark, sf, "customer").groupBy(F.substring("c_name", 1, 10).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT n_name FROM nation ORDER BY n_name DESC")
def comparator_reverse(spark, sf):
    return table(spark, sf, "nation").select("n_name").orderBy(F.desc("n_name"))


_SUM = draw_sql("k || ':' || seq || ':' || op")


@query(f"WITH {LOG} SELECT count(*) n, bit_xor({_SUM}) \"xor\", sum({_SUM})::BIGINT total FROM log")
def kv_checksum(spark, sf):
    """An order-free checksum of a table."""
    return kv.checksum(log(spark, sf), F.concat_ws(":", "k", "seq", "op"))


@query(f"WITH {LOG}, v AS (SELECT k, max(seq) FILTER (kind = 'click') click, max(seq) FILTER (kind <> 'click') other FROM log WHERE seq <= {MIDDLE} GROUP BY k) SELECT k, click, other FROM v")
def kv_snapshot_families(spark, sf):
    """Two families of one log read at the same sequence: the newest version of each key in both."""
    rows = log(spark, sf).select("k", "seq", "kind")
    families = {"click": rows.where("kind = 'click'"), "other": rows.where("kind <> 'click'")}
    return kv.snapshot(families, _middle(spark, sf))


@query(f"WITH {LOG}, m AS (SELECT max(ts) // 86400000 d FROM log) SELECT k, seq, v FROM log, m WHERE ts // 86400000 >= d - 6")
def kv_table_filter(spark, sf):
    """Files of a day each; those whose day is not wanted are never opened."""
    rows = log(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400000))
    last = rows.agg(F.max("day")).first()[0]
    return kv.partitioned(rows, "day", Scratch(spark, "table-filter")).where(F.col("day") >= last - 6).select("k", "seq", "v")


@query("SELECT p_partkey, p_brand FROM part WHERE substr(p_brand, 1, 7) = 'Brand#3'")
def kv_partition_by_prefix(spark, sf):
    """Files cut where the key's prefix changes; a prefix scan opens its own only."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand").withColumn("prefix", F.substring("p_brand", 1, 7))
    return kv.partitioned(rows, "prefix", Scratch(spark, "prefixes"), order="p_brand").where("prefix = 'Brand#3'").select("p_partkey", "p_brand")


@query(f"WITH {LOG}, r AS (SELECT *, max(seq) FILTER (seq < {MIDDLE}) OVER (PARTITION BY k) base FROM log) SELECT k, seq, op, v FROM r WHERE seq >= {MIDDLE} OR seq = base")
def kv_trim_history(spark, sf):
    """Versions below the middle go, but for each key's newest, which reads at the middle still need."""
    return kv.trim_history(log(spark, sf), _middle(spark, sf)).select("k", "seq", "op", "v")


_PLACE = [draw_sql(f"'{i}:' || {{k}}", 4096) for i in range(2)]


@query(f"WITH p AS (SELECT DISTINCT {_PLACE[0].format(k='user_id')} a, {_PLACE[1].format(k='user_id')} b FROM events), s AS (SELECT a FROM p UNION SELECT b FROM p) SELECT c_custkey k, {_PLACE[0].format(k='c_custkey')} IN (SELECT a FROM s) AND {_PLACE[1].format(k='c_custkey')} IN (SELECT a FROM s) maybe FROM customer")
def kv_bloom_filter(spark, sf):
    """Membership by a Bloom filter of 4,096 bits and two hashes: no key that exists is missed."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return kv.bloom_probe(keys, kv.bloom_filter(log(spark, sf), 4096, 2), 4096, 2)


@query(f"WITH {LOG} SELECT k, seq, op, CASE WHEN seq % 7 = 0 THEN v + 1000 ELSE v END v FROM log WHERE kind <> 'view'")
def kv_wal_filter(spark, sf):
    """Records dropped and replaced while the log is replayed."""
    return kv.replayed(log(spark, sf), keep=F.col("kind") != "view", value=F.when(F.col("seq") % 7 == 0, F.col("v") + 1000).otherwise(F.col("v"))).select("k", "seq", "op", "v")


_CODECS = ("uncompressed", "snappy", "gzip", "lz4raw", "zstd")


@query(f"WITH {LOG} SELECT unnest({list(_CODECS)}) codec, count(*) n, bit_xor({_SUM}) \"xor\", sum({_SUM})::BIGINT total FROM log")
def kv_codecs(spark, sf):
    """The log dumped under each compression codec, loaded again and summed."""
    rows = log(spark, sf).select("k", "seq", "op")
    out = None
    for codec in _CODECS:
        path = f"{Scratch(spark, 'dump').dir}/{codec}"
        kv.dump(rows, path, codec)
        one = kv.checksum(kv.load(spark, path, rows.schema), F.concat_ws(":", "k", "seq", "op")).withColumn("codec", F.lit(codec))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOG} SELECT k, seq, ts, op, v FROM log")
def kv_dump_load(spark, sf):
    """A full export and import."""
    rows = log(spark, sf).select("k", "seq", "ts", "op", "v")
    path = f"{Scratch(spark, 'dump').dir}/log"
    kv.dump(rows, path)
    return kv.load(spark, path, rows.schema)


# Merge operators


@query("SELECT user_id k, (sum(floor(value * 100)::HUGEINT) % 18446744073709551616)::DOUBLE v FROM events GROUP BY 1")
def merge_uint64add(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).alias("v"))
    return merge_operators.merge(rows, "uint64add").withColumn("v", F.col("v").cast("double"))


@query("SELECT user_id k, max(event_type) v FROM events GROUP BY 1")
def merge_max(spark, sf):
    return merge_operators.merge(log(spark, sf).select("k", "seq", F.col("kind").alias("v")), "max")


@query("SELECT user_id k, string_agg(event_type, ',' ORDER BY event_id) v FROM events GROUP BY 1")
def merge_stringappend(spark, sf):
    return merge_operators.merge(log(spark, sf).select("k", "seq", F.col("kind").alias("v")), "stringappend")


@query("SELECT user_id k, list_sort(flatten(list([event_id % 100, event_id % 100 + 7]))) v FROM events GROUP BY 1")
def merge_sortlist(spark, sf):
    rows = log(spark, sf).select("k", "seq", F.array(F.col("seq") % 100, F.col("seq") % 100 + 7).alias("v"))
    return merge_operators.merge(rows, "sortlist")


@query("SELECT user_id k, bit_xor(event_id) v FROM events GROUP BY 1")
def merge_bytesxor(spark, sf):
    return merge_operators.merge(log(spark, sf).select("k", "seq", F.col("seq").alias("v")), "bytesxor")


@query("SELECT user_id k, arg_max(event_type, event_id) v FROM events GROUP BY 1")
def merge_put(spark, sf):
    return merge_operators.merge(log(spark, sf).select("k", "seq", F.col("kind").alias("v")), "put")


@query(f"WITH {LOG}, d AS (SELECT k, max(seq) d FROM log WHERE op = 'DEL' GROUP BY k) SELECT log.k, string_agg(kind, ',' ORDER BY seq) v FROM log LEFT JOIN d ON log.k = d.k WHERE op <> 'DEL' AND seq > coalesce(d, -1) GROUP BY log.k")
def merge_after_delete(spark, sf):
    """Operands after a key's last deletion only."""
    rows = log(spark, sf).select("k", "seq", F.when(F.col("op") == "DEL", "DEL").otherwise("MERGE").alias("op"), F.col("kind").alias("v"))
    return merge_operators.merge(rows, "stringappend", op="op")


@query("""WITH RECURSIVE o AS (SELECT user_id k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n, CASE WHEN event_id % 4 = 0 THEN 'sum' WHEN event_id % 4 = 1 THEN 'max' WHEN event_id % 4 = 2 THEN 'last' WHEN user_id % 3 > 0 THEN 'sum' END f, floor(value)::DOUBLE v FROM events),
named AS (SELECT k, min(n) FILTER (f IS NOT NULL) first FROM o GROUP BY k),
bad AS (SELECT o.k, list(o.v ORDER BY n) packed FROM o JOIN named ON named.k = o.k GROUP BY o.k HAVING min(first) IS NULL OR bool_or(f IS NULL AND n > first)),
r AS (SELECT k, n, f, v total, v most, v last FROM o WHERE n = 1 AND k NOT IN (SELECT k FROM bad)
 UNION ALL SELECT o.k, o.n, coalesce(o.f, r.f),
  CASE WHEN o.f <> r.f THEN (CASE r.f WHEN 'sum' THEN r.total WHEN 'max' THEN r.most ELSE r.last END) + o.v ELSE r.total + o.v END,
  CASE WHEN o.f <> r.f THEN greatest((CASE r.f WHEN 'sum' THEN r.total WHEN 'max' THEN r.most ELSE r.last END), o.v) ELSE greatest(r.most, o.v) END, o.v
 FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)
SELECT k, f func, CASE f WHEN 'sum' THEN total WHEN 'max' THEN most WHEN 'last' THEN last END v, NULL::DOUBLE[] packed FROM r WHERE n = (SELECT max(n) FROM o WHERE o.k = r.k)
UNION ALL SELECT k, 'error', NULL, packed FROM bad""")
def agg_merge_switch(spark, sf):
    """Operands name sum, max or last by event_id modulo 4; a third of the users also have operands without a name."""
    n = F.col("event_id") % 4
    f = F.when(n == 0, "sum").when(n == 1, "max").when(n == 2, "last").when(F.col("user_id") % 3 > 0, "sum")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), f.alias("func"), F.floor("value").cast("double").alias("v"))
    return merge_operators.switching(rows)


@query("WITH e AS (SELECT l_orderkey \"row\", l_linenumber name, max(l_quantity) q FROM lineitem GROUP BY 1, 2) SELECT \"row\", list(name ORDER BY name) names, list(q ORDER BY name) vals FROM e GROUP BY 1")
def wide_entity(spark, sf):
    """Orders as entities whose columns are their line numbers."""
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("name"), F.col("l_quantity").alias("value"))
    w = kv.wide_rows(cells, "row", "name", "value")
    return w.select("row", F.map_keys("columns").alias("names"), F.map_values("columns").alias("vals"))


_CELLS = "c AS (SELECT user_id \"row\", event_type name, event_id ts, event_id % 9 = 4 deleted, CASE WHEN event_id % 3 = 0 THEN 500 ELSE 0 END ttl, value FROM events), n AS (SELECT max(ts) now FROM c), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"row\", name ORDER BY ts DESC) r FROM c) WHERE r = 1)"


@query(f"WITH {_CELLS}, s AS (SELECT w.*, deleted OR (ttl > 0 AND ts + ttl < now) dead, now FROM w, n) SELECT \"row\", name, CASE WHEN dead THEN 'tombstone' ELSE 'live' END state, CASE WHEN NOT dead THEN value END value, ts FROM s WHERE NOT dead OR ts + 2000 >= now")
def wide_row_merge(spark, sf):
    """Cells (user, event type): newest wins, every third expires after 500 events, tombstones go after 2,000."""
    e = table(spark, sf, "events")
    cells = e.select(F.col("user_id").alias("row"), F.col("event_type").alias("name"), F.col("event_id").alias("ts"), (F.col("event_id") % 9 == 4).alias("deleted"), F.when(F.col("event_id") % 3 == 0, 500).otherwise(0).alias("ttl"), "value")
    now = e.agg(F.max("event_id")).first()[0]
    return kv.wide_merge(cells, F.lit(now), grace=F.lit(2000))


@query(f"WITH {LOG}, p AS (SELECT *, {draw_sql('k', 16)}::INT part FROM log), d AS (SELECT part, sum((op = 'DEL')::INT) OVER (PARTITION BY part ORDER BY k, seq ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) d FROM p) SELECT part, count(*) n, sum((d >= 5)::INT)::BIGINT n_dense FROM d GROUP BY 1")
def deletion_density(spark, sf):
    return kv.deletion_density(log(spark, sf), 32, 5, 16)


# Access logs


@query("SELECT event_type op, count(*) n, count(DISTINCT user_id) n_keys FROM events GROUP BY 1")
def trace_counts(spark, sf):
    return trace.by_type(table(spark, sf, "events").withColumnRenamed("event_type", "op"), "op", "user_id")


@query("SELECT event_type op, floor(epoch(ts) / 3600)::BIGINT * 3600 start, count(*) n FROM events GROUP BY 1, 2")
def trace_qps(spark, sf):
    """Accesses of each hour."""
    return trace.per_second(table(spark, sf, "events").select(F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts")), "op", "ts", 3600)


@query("SELECT * FROM (SELECT event_type op, user_id k, count(*) n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) rank FROM events GROUP BY 1, 2) WHERE rank <= 10")
def trace_topk_keys(spark, sf):
    return trace.top_keys(table(spark, sf, "events").select(F.col("event_type").alias("op"), F.col("user_id").alias("k")), "op", "k", 10)


@query("SELECT accesses, count(*) n_keys FROM (SELECT user_id, count(*) accesses FROM events GROUP BY 1) GROUP BY 1")
def trace_key_stats(spark, sf):
    return trace.count_histogram(table(spark, sf, "events"), "user_id")


@query("SELECT length(props) // 2 * 2 low, count(*) n FROM events GROUP BY 1")
def trace_size_distribution(spark, sf):
    return trace.size_histogram(table(spark, sf, "events"), F.length("props"), 2)


@query("SELECT user_id k, count(*) n, min(g) least, sum(g) / count(*) mean, max(g) most FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) g FROM events) WHERE g IS NOT NULL GROUP BY 1")
def trace_reuse_distance(spark, sf):
    return trace.reuse_interval(table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id"), "k", "event_id")


@query("WITH f AS (SELECT k.user_id, t.event_type, count(e.event_id) n FROM (SELECT DISTINCT user_id FROM events) k CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = k.user_id AND e.event_type = t.event_type GROUP BY 1, 2) SELECT x.event_type a, y.event_type b, round(corr(x.n, y.n), 6) r FROM f x JOIN f y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2")
def trace_correlation(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("op"), F.col("user_id").alias("k"))
    return trace.co_access(e, "op", "k").withColumn("r", F.round("r", 6))


_SEGMENTS = "s AS (SELECT user_id % 16 file, event_id // 1000 step, count(*)::DOUBLE lookups, sum((event_type = 'click')::INT)::DOUBLE hits, avg(value) similarity FROM events GROUP BY 1, 2)"


@query(
    f"WITH {_SEGMENTS}, g AS (SELECT *, max(step) OVER (PARTITION BY file) last, coalesce(step - lag(step) OVER (PARTITION BY file ORDER BY step), 1) gap FROM s), "
    "x AS (SELECT file, last, exp(-0.9::DOUBLE * (last - step)) * (1 - exp(-0.9::DOUBLE * gap)) w, lookups, hits, similarity FROM g), "
    "t AS (SELECT file, sum(lookups * w) a, sum(hits * w) h, sum(similarity * w) s, ((SELECT max(step) FROM s) - max(last))::DOUBLE age FROM x GROUP BY file) "
    "SELECT file, round(a, 6) access_score, round(h, 6) hit_score, round(s, 6) similarity_score, round(100 * a + 100 * h + 0.1 * s + 0.1 * age, 6) temperature FROM t"
)
def segment_temperature(spark, sf):
    """Segments of users; a record for each thousand events; similarity is the mean value, age the steps since the last record."""
    e = table(spark, sf, "events")
    a = e.groupBy((F.col("user_id") % 16).alias("file"), F.floor(F.col("event_id") / 1000).alias("step")).agg(F.count("*").alias("lookups"), F.sum((F.col("event_type") == "click").cast("int")).alias("hits"), F.avg("value").alias("similarity"))
    t = trace.temperature(a)
    return t.select("file", *[F.round(c, 6).alias(c) for c in ("access_score", "hit_score", "similarity_score", "temperature")])


_STACK = f"a AS MATERIALIZED (SELECT user_id k, event_id i, {draw_sql('user_id', 4)}::INT shard, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events), d AS (SELECT a.k, a.i, a.shard, a.p, count(b.i) FILTER (b.p IS NULL OR b.p <= a.p) n FROM a LEFT JOIN a b ON b.shard = a.shard AND b.i > a.p AND b.i < a.i GROUP BY ALL)"


@query(f"WITH {_STACK} SELECT k, i event_id, n distance FROM d WHERE p IS NOT NULL")
def trace_stack_distance(spark, sf):
    """Distinct keys of a shard between two accesses of one key."""
    return trace.stack_distance(table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id"), 4, "k", "event_id").where("distance >= 0").select("k", "event_id", "distance")


@query(f"WITH {_STACK}, c AS (SELECT unnest([16, 64, 256]) capacity) SELECT capacity, count(*) n, sum((p IS NULL OR n >= capacity // 4)::INT)::BIGINT misses, sum((p IS NULL OR n >= capacity // 4)::INT) / count(*) miss_ratio FROM d, c GROUP BY 1")
def cache_miss_ratio(spark, sf):
    return trace.miss_ratio(table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id"), 4, [16, 64, 256], "k", "event_id")


@query("WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 n, user_id % 8 segments FROM events WHERE event_type = 'click'), r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 n, value latency FROM events WHERE event_type = 'purchase') SELECT s.n, segments, latency FROM s JOIN r ON r.n = s.n")
def searched_pairs(spark, sf):
    """Segments searched next to latencies, paired by ordinal."""
    e = table(spark, sf, "events")
    s = trace.numbered(e.where("event_type = 'click'").select("event_id", (F.col("user_id") % 8).alias("segments")), "event_id")
    r = trace.numbered(e.where("event_type = 'purchase'").select("event_id", F.col("value").alias("latency")), "event_id")
    return trace.paired(s.drop("event_id"), r.drop("event_id"))
