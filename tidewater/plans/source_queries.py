"""Registered queries of sources and sinks: written in the shared folder, read back, compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import vector_queries as V
from tidewater.session import Scratch
from tidewater.sources import vectors as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT 'I' op, vec_id id, 64 dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) total FROM embeddings UNION ALL SELECT 'D', vec_id, NULL, NULL FROM embeddings WHERE vec_id % 10 = 3")
def text_source(spark, sf):
    """Mutations written as text lines and parsed again."""
    v = V.vectors(spark, sf).select("id", "v")
    m = v.withColumn("op", F.lit("I")).unionByName(v.where("id % 10 = 3").select("id", F.lit(None).cast("array<float>").alias("v"), F.lit("D").alias("op")))
    scratch = Scratch(spark, "text-source")
    S.as_lines(m).write.text(f"{scratch.dir}/lines")
    back = S.parse(spark.read.text(f"{scratch.dir}/lines"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("op", "id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), F.round(total, 6).alias("total"))


@query("SELECT 0 phase, 'I' op, vec_id id FROM embeddings UNION ALL SELECT 1, 'Q', vec_id FROM embeddings WHERE vec_id % 20 = 0")
def vectors_then_queries(spark, sf):
    v = V.vectors(spark, sf).select("id", "v")
    return S.vectors_then_queries(v, v.where("id % 20 = 0")).select("phase", "op", "id")


@query("SELECT 'I' op, vec_id id, 64 dim FROM embeddings UNION ALL SELECT 'Q', vec_id, 64 FROM embeddings WHERE vec_id % 20 = 0")
def hybrid_source(spark, sf):
    """Inserts and queries in one file of text lines."""
    v = V.vectors(spark, sf).select("id", "v")
    both = v.withColumn("op", F.lit("I")).unionByName(v.where("id % 20 = 0").withColumn("op", F.lit("Q")))
    lines = Scratch(spark, "hybrid").keep(S.as_lines(both), "lines", "text")
    return S.parse(lines).select("op", "id", F.size("v").alias("dim"))


def _file(spark, sf, kind: str) -> str:
    path = f"{Scratch(spark, kind).dir}/rows.{kind}"
    rows = V.vectors(spark, sf)
    if kind == "bvecs":
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.abs(x) * 255).cast("int")))
    S.write(rows, path, kind)
    return path


@query("SELECT vec_id id, embedding v FROM embeddings")
def fvecs_source(spark, sf):
    """All vectors written as fvecs records and read in splits."""
    return S.read(spark, _file(spark, sf, "fvecs"), "fvecs", V.DIM)


@query("SELECT vec_id id, list_transform(embedding, lambda x: floor(abs(x) * 255)::FLOAT) v FROM embeddings")
def bvecs_source(spark, sf):
    """Components as unsigned bytes."""
    return S.read(spark, _file(spark, sf, "bvecs"), "bvecs", V.DIM)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sorted_table_ingest(spark, sf):
    """A sorted external table written by key ranges and read back."""
    from tidewater.session import table

    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Scratch(spark, "ingest").keep(orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey"), "sorted")


@query("SELECT vec_id - 50 + 100 * p id, embedding v FROM embeddings, (VALUES (0), (1)) l(p) WHERE vec_id >= 50 AND vec_id < 150")
def skip_limit_loop(spark, sf):
    """Records 50 to 149 of a file in two passes, ids going on over passes."""
    rows = S.read(spark, _file(spark, sf, "fvecs"), "fvecs", V.DIM, skip=50, limit=100, loops=2)
    return rows.withColumn("id", F.col("id") - 50)


@query(V.SQL["knn_l2"].replace("SELECT query_id, rank, id, round(dist, 9) dist", "SELECT query_id, list(id ORDER BY rank) ids", 1) + " GROUP BY query_id")
def truth_source(spark, sf):
    """Exact neighbours written as ivecs records, one for each query in order, and read as truth."""
    found = V.knn_l2(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("int")).alias("v"))
    path = f"{Scratch(spark, 'truth').dir}/truth.ivecs"
    S.write(found, path, "ivecs", "query_id")
    return S.truth(S.read(spark, path, "ivecs", V.K), V.K).withColumn("query_id", F.col("query_id") * 20)


@query("SELECT vec_id id, 1700000000000 + vec_id // 4 * 2 event_time, vec_id + 1000000 new_id FROM embeddings")
def throttled_source(spark, sf):
    """Rows stamped with the event time that 2,000 rows a second give in groups of four, and numbered anew."""
    from tidewater.operators.changelog import throttled

    return throttled(V.vectors(spark, sf).select("id"), 2000, start=1_700_000_000_000, first_id=1_000_000, group=4).select("id", "event_time", "new_id")
