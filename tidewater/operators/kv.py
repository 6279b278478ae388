"""Key-value log operators: log(k, seq, ts, op, v) rows with op PUT, DEL, SDEL, MERGE or RDEL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.draws import draw
from tidewater.operators.changelog import latest
from tidewater.session import Scratch


def view(log: DataFrame, *, snapshot: Column | None = None, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """The newest put of each key, at a snapshot if given."""
    return latest(log, key, seq, at=snapshot).where(F.col(op) == "PUT")


def scan(rows: DataFrame, *, low: object = None, high: object = None, prefix: str | None = None, key: str = "k", reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in order of key: low inclusive, high exclusive; all pushed to the source. A limit becomes a top-k."""
    out = rows
    if low is not None:
        out = out.where(F.col(key) >= F.lit(low))
    if high is not None:
        out = out.where(F.col(key) < F.lit(high))
    if prefix is not None:
        out = out.where(F.col(key).startswith(prefix))
    out = out.orderBy(F.desc(key) if reverse else F.asc(key))
    return out if limit is None else out.limit(limit)


def seek_for_prev(rows: DataFrame, target: object, key: str = "k") -> DataFrame:
    """The last row at or before the target."""
    return rows.where(F.col(key) <= F.lit(target)).orderBy(F.desc(key)).limit(1)


def multi_get(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """Every asked key with its row, nulls where there is none."""
    return keys.join(rows, key, "left")


def may_exist(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """keys with `found`; exact, since a semi join costs no more than a filter here."""
    have = rows.select(key).distinct().withColumn("found", F.lit(True))
    return keys.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def history(log: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """All versions of [start, end]."""
    return log.where(F.col(ts).between(start, end))


def unexpired(rows: DataFrame, now: Column, ttl: Column, ts: Column) -> DataFrame:
    """Rows whose ttl is not over; 0 or less never is."""
    return rows.where((ttl <= 0) | (ts + ttl >= now))


def overlay(base: DataFrame, delta: DataFrame, key: str = "k", value: str = "v", op: str = "op") -> DataFrame:
    """A base table with an indexed batch over it: puts replace, deletes hide."""
    d = delta.select(key, F.col(op).alias("_op"), F.col(value).alias("_v"))
    out = base.select(key, value).join(d, key, "full_outer").where(F.coalesce("_op", F.lit("PUT")) != "DEL")
    return out.select(key, F.when(F.col("_op").isNotNull(), F.col("_v")).otherwise(F.col(value)).alias(value))


def committed(log: DataFrame, marks: DataFrame, txn: str = "txn") -> DataFrame:
    """Rows of transactions that a commit mark names."""
    return log.join(marks.select(txn).distinct(), txn, "left_semi")


def compact(log: DataFrame, *, keep: Column | None = None, value: Column | None = None, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """The view as a table, through a compaction filter: `keep` drops rows, `value` replaces values."""
    out = view(log, key=key, seq=seq, op=op)
    if keep is not None:
        out = out.where(keep)
    return out if value is None else out.withColumn("v", value)


def range_sizes(rows: DataFrame, bounds: list, size: Column, key: str = "k") -> DataFrame:
    """(range, n, bytes) of the ranges between neighbouring bounds."""
    r = sum((F.when(F.col(key) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    return rows.withColumn("range", r).groupBy("range").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def wide_rows(cells: DataFrame, row: str, name: str, value: str, order: str | None = None) -> DataFrame:
    """Entities: a map of column names to values for each row, the newest where a name repeats."""
    newest = cells.groupBy(row, name).agg((F.max_by(value, order) if order else F.max(value)).alias(value))
    return newest.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("columns"))


def wide_merge(cells: DataFrame, now: Column, *, row: str = "row", name: str = "name", ts: str = "ts", ttl: str = "ttl", deleted: str = "deleted", value: str = "value", grace: Column | None = None) -> DataFrame:
    """(row, name, state, value, ts): the newest cell of each (row, column).

    An expired cell becomes a tombstone; a tombstone goes when it is older than the grace period.
    """
    c = F.struct(F.col(ts).alias("ts"), F.col(deleted).alias("deleted"), F.col(ttl).alias("ttl"), F.col(value).alias("value"))
    newest = cells.groupBy(row, name).agg(F.max(c).alias("c")).select(row, name, "c.*")
    dead = F.col("deleted") | ((F.col("ttl") > 0) & (F.col("ts") + F.col("ttl") < now))
    out = newest.select(row, name, F.when(dead, "tombstone").otherwise("live").alias("state"), F.when(~dead, F.col("value")).alias("value"), "ts")
    return out if grace is None else out.where((F.col("state") == "live") | (F.col("ts") + grace >= now))


def deletion_density(log: DataFrame, window: int, least: int, buckets: int = 64, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """(part, n, n_dense): rows at which the last `window` rows, in key order, hold `least` deletions or more.

    Parts are hash ranges of the key, as files would be: the frame never leaves its part.
    """
    part = draw(F.col(key), buckets).cast("int")
    frame = Window.partitionBy("part").orderBy(key, seq).rowsBetween(1 - window, 0)
    d = F.sum((F.col(op) == "DEL").cast("int")).over(frame)
    return log.withColumn("part", part).withColumn("d", d).groupBy("part").agg(F.count("*").alias("n"), F.sum((F.col("d") >= least).cast("int")).alias("n_dense"))


def checksum(rows: DataFrame, text: Column) -> DataFrame:
    """One row (n, xor, total): sums of the rows' draws, the same in any order."""
    return rows.select(draw(text).alias("d")).agg(F.count("*").alias("n"), F.bit_xor("d").alias("xor"), F.sum("d").alias("total"))


def snapshot(families: dict[str, DataFrame], at: int, key: str = "k", seq: str = "seq") -> DataFrame:
    """(key, a column of each family): the newest sequence of every key in every family, all read at one sequence."""
    rows = [df.where(F.col(seq) <= at).select(key, F.lit(name).alias("family"), seq) for name, df in families.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy(key).pivot("family", list(families)).agg(F.max(seq))


def partitioned(rows: DataFrame, by: str, scratch: Scratch, order: str | None = None) -> DataFrame:
    """rows written in files cut where `by` changes (sorted within), and read back: filters on `by` prune files."""
    dealt = rows.repartition(by)
    (dealt.sortWithinPartitions(by, order) if order else dealt).write.partitionBy(by).parquet(f"{scratch.dir}/files")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{scratch.dir}/files")


def trim_history(log: DataFrame, low: int, key: str = "k", seq: str = "seq") -> DataFrame:
    """The log without versions below `low` that no read at `low` or later needs: each key keeps its newest below."""
    old = log.where(F.col(seq) < low)
    needed = old.groupBy(key).agg(F.max(seq).alias(seq))
    return log.where(F.col(seq) >= low).unionByName(old.join(needed, [key, seq], "left_semi").select(*log.columns))


def _places(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*[draw(F.concat_ws(":", F.lit(i), key.cast("string")), bits) for i in range(hashes)])


def bloom_filter(rows: DataFrame, bits: int, hashes: int, key: str = "k") -> DataFrame:
    """(bucket, m): a Bloom filter of a fixed number of bits as bitmaps of 32,768 each, built by partial aggregates."""
    each = rows.select(F.explode(_places(F.col(key), bits, hashes)).alias("p"))
    return each.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m"))


def bloom_probe(keys: DataFrame, filter_: DataFrame, bits: int, hashes: int, key: str = "k") -> DataFrame:
    """keys with `maybe`: false only for keys that are surely not there."""
    place = F.explode(F.array_distinct(_places(F.col(key), bits, hashes)))
    each = keys.select(key).distinct().withColumn("p", place).withColumn("bucket", F.bitmap_bucket_number(F.col("p") + 1))
    at = F.bitmap_bit_position(F.col("p") + 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("m"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, at % 8) == 1, F.lit(False))
    found = each.join(filter_, "bucket", "left").groupBy(key).agg(F.min(hit.cast("int")).alias("hit"))
    return keys.join(found, key, "left").withColumn("maybe", F.col("hit") == 1).drop("hit")


def replayed(log: DataFrame, *, keep: Column | None = None, value: Column | None = None, v: str = "v") -> DataFrame:
    """The log as a filter lets it through: records dropped, values replaced."""
    out = log if keep is None else log.where(keep)
    return out if value is None else out.withColumn(v, value)


def dump(rows: DataFrame, path: str, codec: str = "zstd") -> None:
    rows.write.option("compression", "lz4_raw" if codec == "lz4raw" else codec).parquet(path)


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
