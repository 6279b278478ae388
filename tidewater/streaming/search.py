"""Structured Streaming: insert, delete and search in keyed state, buffers, and the merge of partial results.

All operators keep their state in the RocksDB state store. Within a micro-batch rows are applied in
order of (event_time, mutations before queries, seq). Across micro-batches the newest version of an id
decides, whatever the order of arrival: deletions leave tombstones in the state, so that an older
insert that comes later stays dead. With a retention, mutations older than the newest less the
retention are too late and dropped, and tombstones of that age go; without one, tombstones stay. A
query that is older than the newest query its partition has seen is late: it is not searched, but
answers with an empty list and late = true, so that its merge still completes. Time to live is a bound
of each query, as in the batch search. A batch without queries reads the state of its own ids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.session import Scratch

NEIGHBORS = "array<struct<dist:double,id:bigint>>"
PARTIAL = f"query_id long, partition_id int, n_sent int, late boolean, neighbors {NEIGHBORS}"
BUFFERED = "partition_id int, op string, id long, event_time long, seq long"
MERGED = f"query_id long, n_combined int, n_to_combine int, neighbors {NEIGHBORS}"


class SearchProcessor(StatefulProcessor):
    """Rows op (I, D, Q), id, v, event_time, seq, ttl, n_sent of one partition -> partial results of its queries."""

    def __init__(self, k: int, retention: int | None = None):
        self.k, self.retention = k, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "id long", "v array<double>, event_time long, seq long")
        self.dead = handle.getMapState("dead", "id long", "event_time long, seq long")
        self.clock = handle.getValueState("clock", "query long, mutation long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        query, newest = self.clock.get() if self.clock.exists() else (-1, -1)
        batch = pd.concat(list(rows), ignore_index=True)
        batch["rank"] = (batch["op"] == "Q").astype(int)
        mutated = {int(i) for i in batch.loc[batch["rank"] == 0, "id"]}
        if batch["rank"].any():
            live = {k[0]: (np.array(x[0], dtype=np.float64), x[1], x[2]) for k, x in self.rows.iterator()}
        else:
            live = {i: (np.array(x[0], dtype=np.float64), x[1], x[2]) for i in mutated if (x := self._have(self.rows, i))}
        dead = {i: x for i in mutated if (x := self._have(self.dead, i))}
        changed: set[int] = set()
        out = []
        for op, i, v, t, seq, ttl, n in batch.sort_values(["event_time", "rank", "seq"])[["op", "id", "v", "event_time", "seq", "ttl", "n_sent"]].itertuples(index=False):
            i, t, seq = int(i), int(t), int(seq)
            if op == "Q":
                late = t < query
                query = max(query, t)
                out.append((i, key[0], n, late, [] if late else self._nearest(live, np.asarray(v, dtype=np.float64), t, max(0, t - int(ttl)))))
                continue
            if self.retention is not None and t < newest - self.retention:
                continue
            newest = max(newest, t)
            have = live.get(i)
            if (have and have[1:] > (t, seq)) or dead.get(i, (-1, -1)) > (t, seq):
                continue
            changed.add(i)
            if op == "I":
                live[i] = (np.asarray(v, dtype=np.float64), t, seq)
                dead.pop(i, None)
            else:
                live.pop(i, None)
                dead[i] = (t, seq)
        for i in changed:
            self._put(self.rows, i, (live[i][0].tolist(), *live[i][1:]) if i in live else None)
            self._put(self.dead, i, dead.get(i))
        if self.retention is not None:
            for i in [k[0] for k, x in self.dead.iterator() if x[0] < newest - self.retention]:
                self.dead.removeKey((i,))
        self.clock.update((int(query), int(newest)))
        yield pd.DataFrame(out, columns=["query_id", "partition_id", "n_sent", "late", "neighbors"])

    @staticmethod
    def _have(state, i: int) -> tuple | None:
        return tuple(state.getValue((i,))) if state.containsKey((i,)) else None

    @staticmethod
    def _put(state, i: int, value: tuple | None) -> None:
        if value is not None:
            state.updateValue((i,), value)
        elif state.containsKey((i,)):
            state.removeKey((i,))

    def _nearest(self, live: dict, q: np.ndarray, t: int, low: int) -> list[dict]:
        ids = [i for i, (_, ts, _) in live.items() if low <= ts <= t]
        if not ids:
            return []
        x = np.stack([live[i][0] for i in ids])
        d = ((x - q) ** 2).sum(axis=1)
        top = np.flatnonzero(d <= np.partition(d, self.k - 1)[self.k - 1] * (1 + 1e-9)) if len(d) > self.k else np.arange(len(d))  # all that are tied at the cut
        near = sorted((float(sum((a - b) * (a - b) for a, b in zip(q.tolist(), x[j].tolist()))), int(ids[j])) for j in top)
        return [{"dist": a, "id": b} for a, b in near[: self.k]]

    def close(self) -> None:
        pass


class MergeProcessor(StatefulProcessor):
    """Partial results of one query -> its merged result, once all partitions have answered.

    With a timeout (ms of processing time) a query whose partitions do not all answer is given up:
    what has come is its result, and its state goes.
    """

    def __init__(self, k: int, timeout: int | None = None):
        self.k, self.timeout = k, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getMapState("near", "id long", "dist double")
        self.count = handle.getValueState("count", "n int, wanted int")

    def _result(self, key, n: int, wanted: int, top: list[tuple[float, int]]) -> pd.DataFrame:
        self.near.clear()
        self.count.clear()
        if self.timeout is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        return pd.DataFrame({"query_id": [key[0]], "n_combined": [n], "n_to_combine": [wanted], "neighbors": [[{"dist": d, "id": i} for d, i in top]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, wanted = self.count.get() if self.count.exists() else (0, 0)
        if self.timeout is not None and not n:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        best = {k[0]: x[0] for k, x in self.near.iterator()}
        for pdf in rows:
            for sent, list_ in zip(pdf["n_sent"], pdf["neighbors"]):
                n, wanted = n + 1, max(wanted, int(sent))
                for x in list_:
                    best[x["id"]] = min(x["dist"], best.get(x["id"], float("inf")))
        top = sorted((d, i) for i, d in best.items())[: self.k]
        if n >= wanted:
            yield self._result(key, n, wanted, top)
            return
        kept = {i for _, i in top}
        for i in [k[0] for k in self.near.keys()]:
            if i not in kept:
                self.near.removeKey((i,))
        for d, i in top:
            self.near.updateValue((int(i),), (float(d),))
        self.count.update((n, wanted))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            n, wanted = self.count.get()
            yield self._result(key, n, wanted, sorted((x[0], k[0]) for k, x in self.near.iterator())[: self.k])

    def close(self) -> None:
        pass


class BufferProcessor(StatefulProcessor):
    """Mutations of one partition, let through `size` at a time; what is left waits in the state, for `ttl` ms at most if given."""

    def __init__(self, size: int, ttl: int | None = None):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "op string, id long, event_time long, seq long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["op", "id", "event_time", "seq"]
        old = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        new = pd.concat(list(rows), ignore_index=True).sort_values(["event_time", "seq"])[names]
        every = old + list(new.itertuples(index=False, name=None))
        full = len(every) // self.size * self.size
        self.waiting.clear()
        if every[full:]:
            self.waiting.put([(a, int(b), int(c), int(d)) for a, b, c, d in every[full:]])
        yield pd.DataFrame([(key[0], *x) for x in every[:full]], columns=["partition_id", *names])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def search(stream: DataFrame, k: int, retention: int | None = None) -> DataFrame:
    """A stream of routed rows (partition_id, op, id, v, event_time, seq, ttl, n_sent) -> a stream of partial results."""
    return stream.groupBy("partition_id").transformWithStateInPandas(statefulProcessor=SearchProcessor(k, retention), outputStructType=PARTIAL, outputMode="Append", timeMode="None")


def merge(stream: DataFrame, k: int, timeout: int | None = None) -> DataFrame:
    """A stream of partial results -> a stream of merged results."""
    return stream.groupBy("query_id").transformWithStateInPandas(statefulProcessor=MergeProcessor(k, timeout), outputStructType=MERGED, outputMode="Append", timeMode="None" if timeout is None else "ProcessingTime")


def buffer(stream: DataFrame, size: int, ttl: int | None = None) -> DataFrame:
    """A stream of mutations (partition_id, op, id, event_time, seq) -> the same, `size` of a partition at a time."""
    return stream.groupBy("partition_id").transformWithStateInPandas(statefulProcessor=BufferProcessor(size, ttl), outputStructType=BUFFERED, outputMode="Append", timeMode="None" if ttl is None else "ProcessingTime")


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet in the shared folder, and read it back.

    Not for streams with a timeout or ttl: their clock goes on, so they have no end.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    with _rocksdb(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{scratch.dir}/out").option("checkpointLocation", f"{scratch.dir}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.dir}/out")
