"""Sliding-log rate limit on a stream.

``limit_step`` decides a micro-batch with the batch operator, so a busy key is many chunks in time order and no task holds
a key's rows; its state is a published table, seen whole or not at all. ``sliding_limit_stream`` keeps the state in Spark's
store, for sources whose batches hold few rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.limiter import CHUNK, decide, limit_after, micros
from weftline.session import cut_lineage, release
from weftline.sources import snapshots

CLOCK_SCHEMA = "us bigint"


def limit_step(root: str, key: str, ts: str, tiebreak: str, window_seconds: int, limit: int, idle_seconds: int, chunk_rows: int = CHUNK) -> Callable[[DataFrame, int], None]:
    """Step for ``foreachBatch``: the batch's decisions (key, tiebreak, accepted, late) are published under ``root``.

    Rows are decided in time order, after those of earlier batches. A row is ``late`` if it is older than one of its key
    that an earlier batch decided, or by more than ``idle_seconds`` than the newest row of all earlier batches, or has no
    time: it is not accepted and leaves no trace, but comes out. So the state of a key, its last accepted times and the
    latest time seen, can go once the key was idle that long: whatever row might still need it is late. A batch that runs
    again after a failure reads the same state and replaces its own tables.
    """
    span, idle = window_seconds * 1_000_000, idle_seconds * 1_000_000

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"{batch_id:012d}"
        kind = dict(batch.dtypes)
        state = snapshots.read_latest(spark, root, "state", f"{key} {kind[key]}, log array<bigint>, seen bigint", before=run)
        clock = snapshots.read_latest(spark, root, "clock", CLOCK_SCHEMA, before=run).agg(F.max("us")).first()[0]
        known = state.select(F.col(key).alias("_key"), "seen")
        timed = batch.select(key, tiebreak, micros(batch, ts).alias("us")).join(known, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        behind = F.col("us").isNull() | F.coalesce(F.col("us") < F.col("seen"), F.lit(False))
        if clock is not None:
            behind = behind | (F.col("us") < clock - idle)
        timed = cut_lineage(timed.select(key, tiebreak, "us", behind.alias("late")))
        on_time = timed.where("NOT late").drop("late")
        decided = cut_lineage(limit_after(on_time, state.where(F.size("log") > 0).select(key, "log"), key, tiebreak, span, limit, chunk_rows))
        newest = decided.groupBy(key).agg(F.max("us").alias("us"))
        seen = state.select(key, F.col("seen").alias("us")).unionByName(newest).groupBy(key).agg(F.max("us").alias("seen"))
        latest = decided.agg(F.max("us")).first()[0]
        now = max([t for t in (clock, latest) if t is not None], default=None)
        # The last accepted times of a key: each task drops what is further back before the shuffle.
        times = decided.where("accepted").select(key, F.col("us").alias("t"), F.col(tiebreak).cast("string").alias("o")).unionByName(state.select(key, F.explode("log").alias("t"), F.lit(None).cast("string").alias("o")))
        last = times.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("t").desc(), "o"))).where(F.col("n") <= limit)
        logs = last.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list("t")).alias("log"))
        kept = seen.join(logs, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("seen") >= F.lit(now) - idle) if now is not None else seen.withColumn("log", F.lit(None).cast("array<bigint>"))
        in_window = F.filter(F.coalesce("log", F.array().cast("array<bigint>")), lambda t: t > F.col("seen") - span)
        out = decided.select(key, tiebreak, "accepted", F.lit(False).alias("late")).unionByName(
            timed.where("late").select(key, tiebreak, F.lit(False).alias("accepted"), F.lit(True).alias("late")))
        snapshots.publish_run({
            "decisions": out, "state": kept.select(key, in_window.alias("log"), "seen"),
            "clock": spark.createDataFrame([(now,)], CLOCK_SCHEMA),
        }, root, run)
        release(timed, decided)

    return step


def sliding_limit_stream(events: DataFrame, key: str, ts: str, tiebreak: str, window_seconds: int, limit: int) -> DataFrame:
    """(key, tiebreak, accepted, late) for every row; none is lost.

    Rows of a micro-batch are decided in time order, after those of earlier batches. A row older than one that an
    earlier batch has decided is ``late``: its decision came too late to count, so it is not accepted and leaves no
    trace. There is no watermark, which would drop such rows unseen. Of a batch only times and tiebreaks of a key are
    held; the source's admission limit (``maxFilesPerTrigger``) bounds how many meet. The state of a key, ``limit`` + 1
    numbers at most, stays; where keys are busy or many come and go, ``limit_step`` is the one to use.
    """
    span = window_seconds * 1_000_000
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {tiebreak} {types[tiebreak]}, accepted boolean, late boolean"

    def each(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        times, names = [], []
        for b in batches:
            times.append(b["us"].to_numpy())
            names.append(b[tiebreak].to_numpy())
        us, name = np.concatenate(times), np.concatenate(names)
        order = np.lexsort((name, us))
        us, name = us[order], name[order]
        late = us < seen if seen is not None else np.zeros(len(us), dtype=bool)
        flags = np.zeros(len(us), dtype=bool)
        here = us[~late]
        free = np.zeros(len(here), dtype=bool)
        free[limit:] = here[limit:] - here[:-limit] >= span
        flags[~late], kept = decide(here, free, kept, span, limit)
        state.update(([int(t) for t in kept], int(max(us[-1], seen if seen is not None else us[-1]))))
        yield pd.DataFrame({key: [owner[0]] * len(us), tiebreak: name, "accepted": flags, "late": late})

    timed = events.select(key, tiebreak, micros(events, ts).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(
        each, schema, "kept array<bigint>, seen bigint", "append", GroupStateTimeout.NoTimeout
    )
