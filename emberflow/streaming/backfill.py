"""Filling in the past: windows of days, newest first, each written once however often the run is started."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster_state import ClusterState
from .pipeline import ingested

#: Days that a source gives at once.
WINDOW_DAYS = 5


def windows(until: dt.date, days: int, width: int = WINDOW_DAYS) -> list[tuple[dt.date, dt.date]]:
    """(from, until) of the windows, newest first; the oldest may be shorter."""
    out = []
    while days > 0:
        since = until - dt.timedelta(days=min(width, days))
        out.append((since, until))
        days -= (until - since).days
        until = since
    return out


def done(state: ClusterState) -> set[str]:
    """Names of the windows that are filled in."""
    fs, pattern = state._fs(f"{state.folder}/windows/w=*/_SUCCESS")
    return {s.getPath().getParent().getName()[2:] for s in fs.globStatus(pattern) or []}


def backfill(detections: DataFrame, state: ClusterState, until: dt.date, days: int, width: int = WINDOW_DAYS, first: int = 0, most: int | None = None) -> list[str]:
    """Feeds the windows to the stored clusters under the numbers ``first`` .. and tells which it filled in (``most`` at
    most).

    A window's number is its place in the list, so that one that broke off is repeated under its own number and leaves no
    traces; filled ones are skipped.  Detections that are stored are ignored, so windows may overlap with anything else.
    """
    filled, before = [], done(state)
    for i, (since, to) in enumerate(windows(until, days, width)):
        name = f"{since}_{to}"
        if name in before:
            continue
        if most is not None and len(filled) == most:
            break
        day = lambda d: F.lit(str(d)).cast("timestamp")
        found = ingested(detections.where((F.col("acq_datetime") >= day(since)) & (F.col("acq_datetime") < day(to))), first + i, state)
        counts = state.spark.createDataFrame([(found.received, found.inserted)], "received long, inserted long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{state.folder}/windows/w={name}")  # one row: the window's mark
        filled.append(name)
    return filled
