"""A gate for messages: an alert goes out unless one of its key went out at most ``hold`` seconds before it.

Whether an alert goes depends on the last one *sent*, not on the last one, so it is a fold in the order of time.  As a
batch, alerts are cut into runs first: after a gap of more than ``hold`` seconds the fold starts anew, whatever came
before.  Runs are found hour by hour, so that no key has to be sorted in one task, and folded by tasks that hold one
Arrow batch.  As a stream, the time of the last one sent is a key's state, which goes when it can't matter any more.

Alerts of one time are taken by id; those without a key or time never go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "id long, key long, at long, sent boolean"


def _runs(alerts: DataFrame, hold_us: int) -> DataFrame:
    """Alerts (id, key, at in microseconds) with the hour and number in the hour of the run that they belong to."""
    timed = alerts.withColumn("hour", F.floor(F.col("at") / 3_600_000_000).cast("long"))
    hours = timed.groupBy("key", "hour").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    before = F.lag("last").over(Window.partitionBy("key").orderBy("hour"))
    hours = hours.select("key", "hour", before.alias("before"))
    own = Window.partitionBy("key", "hour").orderBy("at", "id")
    gap = F.col("at") - F.coalesce(F.lag("at").over(own), F.col("before"))
    cut = timed.join(hours, ["key", "hour"]).withColumn("starts", F.coalesce(gap > hold_us, F.lit(True)).cast("long"))
    cut = cut.withColumn("n", F.sum("starts").over(own))
    # a run that goes on from hours before belongs to the last hour that starts one
    begun = cut.groupBy("key", "hour").agg(F.max("n").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct("hour", "n")), ignorenulls=True).over(Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    carried = begun.select("key", "hour", last.alias("carried"))
    run = F.when(F.col("n") > 0, F.struct("hour", "n")).otherwise(F.col("carried"))
    return cut.join(carried, ["key", "hour"]).select("id", "key", "at", run.alias("run"))


def chosen(at: np.ndarray, last: int | None, hold_us: int) -> tuple[np.ndarray, int | None]:
    """Which of the sorted times go, given the last one sent, and the last one sent then."""
    sent = np.zeros(len(at), bool)
    i = 0 if last is None else int(np.searchsorted(at, last + hold_us, "right"))
    while i < len(at):
        sent[i], last = True, int(at[i])
        i = int(np.searchsorted(at, last + hold_us, "right"))
    return sent, last


def gated(alerts: DataFrame, hold: int) -> DataFrame:
    """Alerts (id, key, at: timestamp) with ``sent``."""
    hold_us = hold * 1_000_000
    timed = alerts.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("id", "key", F.unix_micros("at").alias("at"))
    runs = _runs(timed, hold_us).select("id", "key", "at", F.col("run.hour").alias("hour"), F.col("run.n").alias("n"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, None
        for batch in batches:
            key, hour, n, at = (batch.column(c).to_numpy() for c in ("key", "hour", "n", "at"))
            sent = np.zeros(len(at), bool)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (hour[1:] != hour[:-1]) | (n[1:] != n[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if (key[a], hour[a], n[a]) != run:
                    run, last = (key[a], hour[a], n[a]), None
                sent[a:b], last = chosen(at[a:b], last, hold_us)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), batch.column("at"), pa.array(sent)], names=["id", "key", "at", "sent"])

    out = runs.repartition("key", "hour", "n").sortWithinPartitions("key", "hour", "n", "at", "id").mapInArrow(fold, _OUT)
    never = alerts.where(F.col("key").isNull() | F.col("at").isNull()).select("id", "key", F.unix_micros("at").alias("at"), F.lit(False).alias("sent"))
    return out.unionByName(never).withColumn("at", F.timestamp_micros("at"))


def gated_stream(alerts: DataFrame, hold: int, lateness: str = "1 hour") -> DataFrame:
    """The same for a stream whose batches come in the order of time (id, key, at)."""
    hold_us = hold * 1_000_000

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["micros", "id"])
        sent, last = chosen(rows["micros"].to_numpy(), last, hold_us)
        state.update((last,))
        # gone once no alert that may still come can be held back by it
        state.setTimeoutTimestamp(max(last // 1000 + hold * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"id": rows["id"], "key": key[0], "at": rows["micros"], "sent": sent})

    timed = alerts.where("key IS NOT NULL").withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("key").applyInPandasWithState(fold, _OUT, "last long", "append", GroupStateTimeout.EventTimeTimeout)
