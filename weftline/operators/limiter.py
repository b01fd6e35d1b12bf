"""Sliding-log rate limit: at most ``limit`` accepted events per key in any window.

Rejected events leave no trace, so acceptance is sequential per key. What needs no sequence is taken out first:

* an idle window resets the log, so each run of busy slots is handled on its own;
* an event whose ``limit``-th predecessor lies a window back is accepted whatever came before (a window function says so),
  and only the rest, with the ``limit`` events before each stretch of it, is decided one after the other;
* a long run is cut into chunks of bounded size. All are decided at once from an empty log, which gives a log at the end of
  each. A chunk is then decided again from the end of the one before, only until both decisions have the same log, and
  again if that end has changed. Chunks whose log never meets the carried one pass it on one by one, as they must.

A chunk streams through Arrow batches in time order; a full log jumps to the event that finds room, so a flood costs its
accepted events and not its rejected ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage, release

#: Slots of a window, and about how many events a chunk has.
SLOTS, CHUNK = 8, 1 << 16


def micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; timestamps without a zone do not depend on the session's zone."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts))


def decide(us: np.ndarray, free: np.ndarray, log: list[int], span: int, limit: int) -> tuple[np.ndarray, list[int]]:
    """Which events, in order of time, are accepted after those of the log, and the log then.

    ``free`` marks events that are accepted whatever came before, each stretch of them at least ``limit`` long or
    following the events it was judged by.
    """
    flags = np.zeros(len(us), dtype=bool)
    bound = np.flatnonzero(~free).tolist()
    log, at, n = list(log), 0, len(us)
    while at < n:
        if free[at]:
            k = bisect_left(bound, at)
            stop = bound[k] if k < len(bound) else n
            flags[at:stop] = True
            log = [*log, *us[max(at, stop - limit) : stop].tolist()][-limit:]
            at = stop
            continue
        now = int(us[at])
        while log and log[0] <= now - span:
            log.pop(0)
        if len(log) < limit:
            flags[at] = True
            log.append(now)
            at += 1
        else:
            at = int(np.searchsorted(us, log[0] + span))
    if n:
        log = [t for t in log if t > int(us[-1]) - span]
    return flags, log


def _chunks(events: DataFrame, key: str, tiebreak: str, span: int, limit: int, size: int, logs: DataFrame | None = None) -> DataFrame:
    """Events with their run, chunk, number of chunks, and whether they are free and whether they must be decided in turn.

    Runs and chunks come from counts by slot: the window over a key sees a row for each slot, not for each event.
    """
    slot = F.floor(F.col("us") / F.lit(span / SLOTS)).cast("long")
    placed = events.withColumn("slot", slot)
    over = Window.partitionBy(key).orderBy("slot")
    counts = placed.groupBy(key, "slot").agg(F.count("*").alias("n"))
    runs = counts.withColumn("begins", F.when(F.col("slot") - F.lag("slot").over(over) <= SLOTS, 0).otherwise(1)).withColumn("run", F.sum("begins").over(over))
    within = Window.partitionBy(key, "run").orderBy("slot")
    runs = runs.withColumn("chunk", F.floor((F.sum("n").over(within) - F.col("n")) / F.lit(size)).cast("long"))
    runs = runs.withColumn("last", F.max("chunk").over(Window.partitionBy(key, "run"))).select(F.col(key).alias("_key"), F.col("slot").alias("_slot"), "run", "chunk", "last")
    rows = placed.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot"))).drop("_key", "_slot", "slot")
    order = Window.partitionBy(key, "run", "chunk").orderBy("us", tiebreak)
    # Only a key's first run can follow a log from before.
    rows = rows.withColumn("after", F.lit(False)) if logs is None else rows.join(
        logs.select(F.col(key).alias("_key"), F.lit(True).alias("_after")), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("after", F.col("_after").isNotNull() & (F.col("run") == 1)).drop("_key", "_after")
    begins = (F.col("chunk") == 0) & ~F.col("after")
    free = F.coalesce(F.col("us") - F.lag("us", limit).over(order) >= span, F.lit(False)) | (begins & (F.row_number().over(order) <= limit))
    rows = rows.withColumn("free", free)
    near = order.rowsBetween(0, limit)
    # The end of a chunk that another follows is decided too, as it gives the log.
    return rows.withColumn("turn", F.max(~F.col("free")).over(near) | ((F.col("chunk") < F.col("last")) & F.lead("us", limit).over(order).isNull()))


def _in_turn(rows: DataFrame, carries: DataFrame | None, key: str, tiebreak: str, span: int, limit: int, ends: bool) -> DataFrame:
    """Decisions of the events of chunks, each chunk in one task, begun from its carried log; or only its log at the end.

    ``carries`` has (key, run, chunk, carry) and, if the log at the end is asked for, ``log``: that of the chunk begun from
    nothing, which is the answer from the point on where both decisions have the same log.
    """
    none = F.lit(None).cast("array<bigint>")
    place = F.xxhash64(key, "run", "chunk").alias("place")
    body = rows.select(place, key, "run", "chunk", "us", tiebreak, "free", none.alias("carry"), none.alias("end"))
    if carries is not None:
        types = dict(rows.dtypes)
        body = body.unionByName(carries.select(
            place, key, "run", "chunk", F.lit(None).cast("bigint").alias("us"), F.lit(None).cast(types[tiebreak]).alias(tiebreak), F.lit(False).alias("free"), "carry", F.col("log").alias("end")))
    ordered = body.repartition(key, "run", "chunk").sortWithinPartitions(key, "run", "chunk", F.col("us").asc_nulls_first(), tiebreak)

    def walk(batches: Iterator[pa.RecordBatch]):
        place, head, log, bare, end, met = None, None, [], None, None, False
        for b in batches:
            places = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else []
            for s, e in zip(cuts, [*cuts[1:], len(places)], strict=True):
                if places[s] != place:
                    if ends and head is not None:
                        yield _end(head, log)
                    place, head, log, bare, end, met = places[s], b.slice(s, 1), [], None, None, False
                if not b.column(4)[s].is_valid:
                    log, end, bare = b.column(7)[s].as_py(), b.column(8)[s].as_py(), []
                    s += 1
                if s == e or met:
                    continue
                part = b.slice(s, e - s)
                us, free = part.column(4).to_numpy(), part.column(6).to_numpy(zero_copy_only=False)
                flags, log = decide(us, free, log, span, limit)
                if not ends:
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(5), part.column(4), pa.array(flags)], [key, tiebreak, "us", "accepted"])
                elif bare is not None:
                    _, bare = decide(us, free, bare, span, limit)
                    if met := bare == log:
                        log = end
        if ends and head is not None:
            yield _end(head, log)

    def _end(head: pa.RecordBatch, log: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([head.column(1), head.column(2), head.column(3), pa.array([log], pa.list_(pa.int64()))], [key, "run", "chunk", "log"])

    types = dict(rows.dtypes)
    schema = f"{key} {types[key]}, run long, chunk long, log array<long>" if ends else f"{key} {types[key]}, {tiebreak} {types[tiebreak]}, us long, accepted boolean"
    return ordered.mapInArrow(walk, schema)


def _carried(turns: DataFrame, logs: DataFrame | None, key: str, tiebreak: str, span: int, limit: int) -> DataFrame:
    """(key, run, chunk, carry, log): the log each chunk begins from, where that is not empty."""
    where = ["run", "chunk"]
    order = Window.partitionBy(key, "run").orderBy("chunk")
    empty = F.array().cast("array<bigint>")
    bare = _in_turn(turns, None, key, tiebreak, span, limit, True)
    if logs is not None:  # a log from before is the end of a chunk before the first
        bare = bare.unionByName(logs.select(key, F.lit(1).cast("long").alias("run"), F.lit(-1).cast("long").alias("chunk"), "log"))
    state = cut_lineage(bare.withColumn("carry", empty).withColumn("log_0", F.col("log")))
    while True:
        told = state.withColumn("next", F.coalesce(F.lag("log").over(order), empty))
        changed = cut_lineage(told.where(F.col("next") != F.col("carry")).select(key, *where, F.col("next").alias("carry"), F.col("log_0").alias("log")))
        if changed.isEmpty():
            release(changed)
            return state.select(key, *where, "carry", "log").where(F.size("carry") > 0)
        wanted = changed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in where])
        same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("run") == F.col("_run")) & (F.col("chunk") == F.col("_chunk"))
        again = _in_turn(turns.join(wanted, same, "left_semi"), changed, key, tiebreak, span, limit, True)
        fresh = again.join(changed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in where], F.col("carry").alias("_carry")), same).select(
            "_k", "_run", "_chunk", "_carry", F.col("log").alias("_log"))
        after = cut_lineage(state.join(fresh, same, "left").select(
            key, *where, F.coalesce("_log", "log").alias("log"), F.coalesce("_carry", "carry").alias("carry"), "log_0"))
        release(state, changed)
        state = after


def limit_after(timed: DataFrame, logs: DataFrame | None, key: str, tiebreak: str, span: int, limit: int, chunk_rows: int = CHUNK) -> DataFrame:
    """(key, tiebreak, us, accepted) of events at ``us``, after the accepted times (key, log) from before, if any."""
    rows = cut_lineage(_chunks(timed, key, tiebreak, span, limit, chunk_rows, logs))
    turns = rows.where("turn")
    long = turns.where("last > 0 OR after")
    carries = None if long.isEmpty() else cut_lineage(_carried(long, logs, key, tiebreak, span, limit))
    if carries is not None:
        carries = carries.where("chunk >= 0")
    decided = _in_turn(turns, carries, key, tiebreak, span, limit, False)
    return decided.unionByName(rows.where("NOT turn").select(key, tiebreak, "us", F.lit(True).alias("accepted")))


def sliding_limit(events: DataFrame, key: str, ts: str, tiebreak: str, window_seconds: int = 60, limit: int = 5, chunk_rows: int = CHUNK) -> DataFrame:
    """(key, tiebreak, accepted) of each event; events of no key are those of one key, events of no time are left out."""
    timed = events.select(key, tiebreak, micros(events, ts).alias("us")).where("us IS NOT NULL")
    return limit_after(timed, None, key, tiebreak, window_seconds * 1_000_000, limit, chunk_rows).drop("us")
