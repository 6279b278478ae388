"""Versioned mutations: latest view, validity intervals, deletes, range deletes, buffering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.draws import draw


def latest(log: DataFrame, key: str, order: str, *, at: Column | None = None) -> DataFrame:
    """The newest row of each key, up to `at` if given. One shuffle, partial aggregates before it."""
    rows = log if at is None else log.where(F.col(order) <= at)
    others = [c for c in log.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in others]).select(*log.columns)


def live(log: DataFrame, key: str, order: str, op: str = "op", deleted: str = "D", *, at: Column | None = None) -> DataFrame:
    return latest(log, key, order, at=at).where(F.col(op) != deleted)


def intervals(log: DataFrame, key: str = "id", time: str = "event_time", seq: str = "seq") -> DataFrame:
    """Each version with valid_to, the time of the key's next version (null: still the newest).

    Of versions of one time only the last by sequence is ever visible.
    """
    by = Window.partitionBy(key).orderBy(time, seq)
    return log.withColumn("valid_to", F.lead(time).over(by)).where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col(time)))


def range_deleted(rows: DataFrame, tombstones: DataFrame, *, key: str = "k", seq: str = "seq", bucket: int = 16) -> DataFrame:
    """rows without those that a newer tombstone [b, e) covers (integer keys).

    Ranges are cut at multiples of `bucket`, so that the join is an equality on the bucket and both
    sides stay partitioned; the tombstones of a bucket shrink to the newest of each distinct range.
    """
    cut = tombstones.where("b < e").groupBy("b", "e").agg(F.max(seq).alias("_s"))
    cut = cut.withColumn("_g", F.explode(F.sequence(F.floor(F.col("b") / bucket), F.floor((F.col("e") - 1) / bucket))))
    left = rows.withColumn("_g", F.floor(F.col(key) / bucket))
    covered = (left["_g"] == cut["_g"]) & (left[key] >= cut["b"]) & (left[key] < cut["e"]) & (cut["_s"] > left[seq])
    return left.join(cut, covered, "left_anti").drop("_g")


def single_deleted(log: DataFrame, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """Puts that no single delete cancels: one cancels the put right before it, and only that one."""
    by = Window.partitionBy(key).orderBy(seq)
    return log.withColumn("_next", F.lead(op).over(by)).where((F.col(op) == "PUT") & (F.coalesce("_next", F.lit("")) != "SDEL")).drop("_next")


def buffered(batch: DataFrame, key: str = "id", time: str = "event_time", op: str = "op") -> DataFrame:
    """A buffer after local cancelling: an insert goes if the batch holds a later delete; of deletes the newest stays."""
    kill = F.max(F.when(F.col(op) == "D", F.col(time))).over(Window.partitionBy(key))
    kept = batch.withColumn("_kill", kill)
    return kept.where(((F.col(op) == "I") & (F.col("_kill").isNull() | (F.col("_kill") <= F.col(time)))) | ((F.col(op) == "D") & (F.col(time) == F.col("_kill")))).drop("_kill")


def inject_deletes(vectors: DataFrame, share: int, seed: int = 66, key: str = "id") -> DataFrame:
    """Mutations with tombstones (that keep their value) for `share` of a thousand ids, chosen by a hash."""
    chosen = draw(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 1000) < share
    return vectors.withColumn("op", F.lit("I")).unionByName(vectors.where(chosen).withColumn("op", F.lit("D")))


def stage_clock(rows: DataFrame, thresholds: list[int], rates: list[float], position: str = "n") -> DataFrame:
    """event_time (ms, cut) of row number n (from 0) under staged rates: `rates[i]` a second from thresholds[i] on.

    A rate below 0 means -rate seconds between rows, 0 no delay.
    """
    if thresholds != sorted(set(thresholds)) or thresholds[:1] != [0]:
        raise ValueError("thresholds must rise from 0")
    step = [interval_ns(r) for r in rates]
    out, base = F.lit(0).cast("bigint"), 0
    for i, (at, s) in enumerate(zip(thresholds, step)):
        if i:
            base += (at - thresholds[i - 1]) * step[i - 1]
        out = F.when(F.col(position) >= at, F.lit(base) + (F.col(position) - at) * F.lit(s)).otherwise(out)
    return rows.withColumn("event_time", F.floor(out / F.lit(1_000_000)).cast("bigint"))


def interval_ns(rate: float) -> int:
    """Nanoseconds between rows at a rate."""
    return int(-rate * 1e9) if rate < 0 else 0 if rate == 0 else int(1e9 / rate)


def without_deletes(log: DataFrame, op: str = "op") -> DataFrame:
    """The log itself, for indexes that take no deletions: one among the rows is an error."""
    refused = F.raise_error(F.lit("this index takes no deletions")).cast("string")
    return log.withColumn(op, F.when(F.col(op) == "D", refused).otherwise(F.col(op))).where(F.col(op).isNotNull())


def throttled(rows: DataFrame, rate: float, *, start: int = 0, first_id: int | None = None, group: int = 1, position: str = "id") -> DataFrame:
    """rows with the event_time (ms, cut) at which a throttle lets row number n (from 0) through, `group` rows at once.

    With first_id, new_id numbers the rows from there.
    """
    slot = F.floor(F.col(position) / group) * group
    out = rows.withColumn("event_time", (F.lit(start) + F.floor(slot * interval_ns(rate) / 1_000_000)).cast("bigint"))
    return out if first_id is None else out.withColumn("new_id", F.col(position) + first_id)
