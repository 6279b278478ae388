"""Verbs on a key-value log in a folder: python -m tidewater.cli FOLDER VERB ...

The log is Parquet of (k, seq, op, end, v), all written by appending; a key's newest row decides.

    put K V | delete K | singledelete K | deleterange B E | batchput K V [K V ...]
    get K | multiget K ... | scan [--low K] [--high K] [--prefix P] [--limit N] [--reverse] | count
    approxsize BOUND ... | dump PATH | load PATH | compact PATH | checkconsistency | history K | uncancelled
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import kv
from tidewater.operators.changelog import single_deleted

SCHEMA = "k string, seq long, op string, end string, v string"


def log(spark: SparkSession, folder: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def append(spark: SparkSession, folder: str, rows: list[tuple[str, str, str | None, str | None]]) -> None:
    """rows (k, op, end, v) after the log's last sequence."""
    last = log(spark, folder).agg(F.max("seq")).first()[0]
    first = 0 if last is None else last + 1
    spark.createDataFrame([(k, first + i, op, end, v) for i, (k, op, end, v) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def live(rows: DataFrame) -> DataFrame:
    """(k, seq, v) of the keys that neither a deletion of theirs nor a newer range deletion hides."""
    points = rows.where("op <> 'RDEL'").withColumn("op", F.when(F.col("op") == "SDEL", "DEL").otherwise(F.col("op")))
    newest = kv.view(points.select("k", "seq", "op", "v")).select("k", "seq", "v")
    cut = rows.where("op = 'RDEL'").select(F.col("k").alias("b"), F.col("end").alias("e"), F.col("seq").alias("s"))
    hidden = (newest["k"] >= cut["b"]) & (newest["k"] < cut["e"]) & (cut["s"] > newest["seq"])
    return newest.join(cut, hidden, "left_anti")  # range deletions typed at a prompt: a handful


def problems(rows: DataFrame) -> DataFrame:
    """What makes a log inconsistent: repeated sequences, unknown operations, puts without a value, single deletes that cancel no put."""
    seq = rows.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated sequence").alias("problem"), F.col("seq"))
    op = rows.where(~F.col("op").isin("PUT", "DEL", "SDEL", "RDEL") | ((F.col("op") == "PUT") & F.col("v").isNull())).select(F.lit("bad operation").alias("problem"), "seq")
    before = F.lag("op").over(Window.partitionBy("k").orderBy("seq"))
    odd = rows.withColumn("before", before).where("op = 'SDEL' and coalesce(before, '') <> 'PUT'").select(F.lit("nothing to cancel").alias("problem"), "seq")
    return seq.unionByName(op).unionByName(odd)


def run(spark: SparkSession, args: list[str]) -> list[str]:
    """The lines that a command prints."""
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder")
    p.add_argument("verb")
    p.add_argument("rest", nargs="*")
    for name in ("low", "high", "prefix"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--reverse", action="store_true")
    a = p.parse_args(args)
    rest, rows = a.rest, log(spark, a.folder)
    shown = lambda df: ["\t".join("" if x is None else str(x) for x in r) for r in df.collect()]
    writes = {
        "put": lambda: [(rest[0], "PUT", None, rest[1])],
        "batchput": lambda: [(k, "PUT", None, v) for k, v in zip(rest[::2], rest[1::2], strict=True)],
        "delete": lambda: [(rest[0], "DEL", None, None)],
        "singledelete": lambda: [(rest[0], "SDEL", None, None)],
        "deleterange": lambda: [(rest[0], "RDEL", rest[1], None)],
    }
    if a.verb in writes:
        append(spark, a.folder, writes[a.verb]())
        return ["OK"]
    if a.verb == "get":
        return shown(live(rows.where((F.col("k") == rest[0]) | (F.col("op") == "RDEL"))).where(F.col("k") == rest[0]).select("v")) or ["not found"]
    if a.verb == "multiget":
        keys = spark.createDataFrame([(k,) for k in rest], "k string")
        return shown(kv.multi_get(live(rows).select("k", "v"), keys).orderBy("k"))
    if a.verb == "scan":
        return shown(kv.scan(live(rows).select("k", "v"), low=a.low, high=a.high, prefix=a.prefix, reverse=a.reverse, limit=a.limit))
    if a.verb == "count":
        return [str(live(rows).count())]
    if a.verb == "approxsize":
        return shown(kv.range_sizes(live(rows), sorted(rest), F.octet_length("k") + F.octet_length("v")).orderBy("range"))
    if a.verb == "history":
        return shown(rows.where(F.col("k") == rest[0]).orderBy("seq").select("seq", "op", "v").limit(a.limit))
    if a.verb == "dump":
        kv.dump(live(rows), rest[0])
        return ["OK"]
    if a.verb == "load":
        last = rows.agg(F.max("seq")).first()[0]
        put = kv.load(spark, rest[0], "k string, seq long, v string").select("k", (F.col("seq") + (0 if last is None else last + 1)).alias("seq"), F.lit("PUT").alias("op"), F.lit(None).cast("string").alias("end"), "v")
        put.write.mode("append").parquet(a.folder)
        return ["OK"]
    if a.verb == "compact":  # beside the log, which readers may still hold
        live(rows).select("k", "seq", F.lit("PUT").alias("op"), F.lit(None).cast("string").alias("end"), "v").write.mode("overwrite").parquet(rest[0])
        return ["OK"]
    if a.verb == "uncancelled":
        return shown(single_deleted(rows).orderBy("k", "seq").select("k", "seq"))
    if a.verb == "checkconsistency":
        return shown(problems(rows)) or ["OK"]
    raise ValueError(f"unknown verb {a.verb}")


if __name__ == "__main__":
    import sys

    from tidewater.session import prepare

    print("\n".join(run(prepare(SparkSession.builder.appName("tidewater").getOrCreate()), sys.argv[1:])))
