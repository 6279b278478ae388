"""Session helpers shared by every operator."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows and bytes that cross to Python at once (Spark's defaults and ours): texts may be long, and each task holds a batch on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2097152b")}
#: Python workers are used again and again: what one task frees goes back at once, and does not stay with the worker.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Files of a written table: WAVES for each slot, and no more than FILE_BYTES of the input for each beyond that.
WAVES, FILE_BYTES = 2, 16 << 20
_own_dir: list[str] = []
_kept: dict[str, Any] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name) == default:  # another value is the user's own
            spark.conf.set(name, ours)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession) -> bool:
    """Whether the driver's JVM is the only executor."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it is unset, a folder of our own in local mode, else one beside the warehouse's tables."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not local(spark):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidewater"
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidewater-"))
    return _own_dir[0]


def trim(spark: SparkSession) -> bool:
    """Give what the driver's JVM has freed outside its heap (compilers, codecs, buffers) back to the system; False where it has no such command.

    Hundreds of threads allocate there, and the C library keeps what they free.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:  # the server's class is not open to calls, its interface is
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time."""
    sc = spark.sparkContext._jsc.sc()
    try:
        return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))
    except Py4JError:
        return max(1, spark.sparkContext.defaultParallelism)


def files_for(df: DataFrame) -> int:
    """How many files a table made from df is worth: one for each FILE_BYTES that Spark expects df to hold, WAVES for each slot at least.

    Where files are local, Hadoop starts a process or more for each file that it makes, each the size of
    the executor's JVM for a moment, and a shuffle of many partitions writes as many files, small as they may be.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(WAVES * slots(df.sparkSession), min(-(-size // FILE_BYTES), (1 << 31) - 1))


def collect(spark: SparkSession) -> None:
    """Have every executor's JVM collect its whole heap, which then shrinks to some three times what is in use.

    By itself a heap stays about as large as it has ever been, mostly garbage, beside the Python
    workers and all that the JVM holds outside it. There is a task for each slot, so that each idle
    executor gets some; what several tasks of one executor ask for at the same time is done once.
    """
    n = slots(spark)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def release(spark: SparkSession) -> None:
    """What no plan refers to any more goes now: the driver's objects, with them their shuffle files on the executors, and the executors' garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)
    if not local(spark):
        collect(spark)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next of its kind; a task of another kind lets it go.

    Workers outlive the operator that they first served, and there is one or more for each core.
    """
    if name not in _kept:
        if _kept:
            _kept.clear()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass
        _kept[name] = make()
    return _kept[name]


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str, files: int | None = None):
        """files: what keep() writes at most (files_for()); without it, one for each partition."""
        self.spark, self.files = prepare(spark), files
        self.dir = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, form: str = "parquet", **options) -> DataFrame:
        path = f"{self.dir}/{name}"
        (df.coalesce(self.files) if self.files else df).write.mode("overwrite").format(form).options(**options).save(path)
        return self.spark.read.schema(df.schema).format(form).load(path)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def release(self) -> None:
        """release() of this session."""
        release(self.spark)

    def drop(self, name: str) -> None:
        """Delete one written table that no later plan reads."""
        path, fs = self._fs(f"{self.dir}/{name}")
        fs.delete(path, True)

    def clear(self, *but: str) -> None:
        """Delete all written tables but those that the result still reads."""
        path, fs = self._fs(self.dir)
        if fs.exists(path):
            for s in fs.listStatus(path):
                if s.getPath().getName() not in but:
                    fs.delete(s.getPath(), True)
