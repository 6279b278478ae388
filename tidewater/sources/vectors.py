"""Vector files: fvecs, bvecs and ivecs records, text lines, and the result and upload formats."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fvecs": ("<f4", 4, "float"), "bvecs": ("u1", 1, "float"), "ivecs": ("<i4", 4, "int")}


def read(spark: SparkSession, path: str, kind: str, dim: int, *, skip: int = 0, limit: int = 0, loops: int = 1, signed: bool = False) -> DataFrame:
    """(id, v): records `[dim][dim numbers]` of one file or folder of files.

    Files are split at whole records by Hadoop's fixed-length input format (the one use of an RDD:
    no DataFrame source reads such ranges), whatever store they are in. Ids count records over the
    files in order of path, from 0, and go on over loops. Bytes are unsigned unless `signed`. A
    record of another dimension, or a cut one, is an error.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    number, width, element = KINDS[kind]
    number = "i1" if kind == "bvecs" and signed else number
    record = 4 + dim * width
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = sorted((str(s.getPath()), s.getLen()) for s in top.getFileSystem(conf).listStatus(top) if s.isFile() and not str(s.getPath().getName()).startswith((".", "_")))
    first, out = 0, None

    def decode(it: Iterator[tuple[int, bytearray]], first: int) -> Iterator[tuple[int, list]]:
        while rows := list(itertools.islice(it, 4096)):
            raw = np.frombuffer(b"".join(bytes(r) for _, r in rows), np.uint8).reshape(-1, record)
            dims = raw[:, :4].copy().view("<i4").ravel()
            if (dims != dim).any():
                raise ValueError(f"a record of dimension {dims[dims != dim][0]}, not {dim}")
            v = raw[:, 4:].copy().view(number).astype(np.int32 if element == "int" else np.float32)
            yield from ((first + at // record, x) for (at, _), x in zip(rows, v.tolist()))

    for p, size in files:
        if size % record:
            raise ValueError(f"{p}: {size} bytes are not records of {record}")
        if size:
            lib = "org.apache.hadoop"
            each = spark.sparkContext.newAPIHadoopFile(p, f"{lib}.mapreduce.lib.input.FixedLengthInputFormat", f"{lib}.io.LongWritable", f"{lib}.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(record)})
            one = spark.createDataFrame(each.mapPartitions(partial(decode, first=first)), f"id long, v array<{element}>")
            out = one if out is None else out.unionByName(one)
        first += size // record
    out = (out if out is not None else spark.createDataFrame([], f"id long, v array<{element}>")).where(F.col("id") >= skip)
    n = max(0, first - skip)
    if limit:
        out, n = out.where(F.col("id") < skip + limit), min(n, limit)
    if loops > 1:
        out = out.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).withColumn("id", F.col("id") + F.col("loop") * n).drop("loop")
    return out


def write(rows: DataFrame, path: str, kind: str, order: str = "id", v: str = "v") -> int:
    """rows in order as one file of records; how many there were.

    Spark has no writer for such files, so the rows pass through the driver, a partition at a time.
    """
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    n = 0
    try:
        it = rows.orderBy(order).select(v).toLocalIterator()
        while some := [r[0] for r in itertools.islice(it, 1024)]:
            out.write(bytearray(encode(some, kind)))
            n += len(some)
    finally:
        out.close()
    return n


def encode(rows: list, kind: str) -> bytes:
    """Records of a small list of vectors (for tests and uploads of fixtures)."""
    number = KINDS[kind][0]
    return b"".join(struct.pack("<i", len(v)) + np.asarray(v).astype(number).tobytes() for v in rows)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(op, id, v) of text lines `[i|q|d][ ]id[,f1,f2...]`; a bare id is a deletion; a bad number is an error.

    op is I, Q or D. The same columns come from `i id,...` hybrid lines, so a stream of both is one table.
    """
    line = F.trim(F.col(column))
    letter = F.regexp_extract(line, "^([iqd])", 1)
    body = F.trim(F.regexp_replace(line, "^[iqd]", ""))
    parts = F.split(body, "[, ]+")
    values = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float"))
    op = F.when((letter == "d") | (F.size(parts) == 1), "D").when(letter == "q", "Q").otherwise("I")
    return lines.where(F.length(line) > 0).select(op.alias("op"), parts[0].cast("long").alias("id"), F.when(F.size(values) > 0, values).alias("v"))


def as_lines(mutations: DataFrame, prefix: bool = True) -> DataFrame:
    """(value): lines that parse() reads back."""
    body = F.concat_ws(",", F.col("id").cast("string"), F.when(F.col("op") != "D", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    return mutations.select((F.concat(F.lower("op"), F.lit(" "), body) if prefix else body).alias("value"))


def truth(records: DataFrame, k: int) -> DataFrame:
    """(query_id, ids): the first k ids of ivecs records."""
    return records.select(F.col("id").alias("query_id"), F.slice(F.transform("v", lambda x: x.cast("long")), 1, k).alias("ids"))


def vectors_then_queries(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """One table in which all vectors come before all queries, by `phase`."""
    return vectors.withColumns({"op": F.lit("I"), "phase": F.lit(0)}).unionByName(queries.withColumns({"op": F.lit("Q"), "phase": F.lit(1)}))
