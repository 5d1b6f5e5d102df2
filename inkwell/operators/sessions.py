"""Sessions: runs of events of a key without a gap of ``gap`` or more, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a cell: a key's events of one cell meet in a task, so that a hot key is many tasks' work.
CELL = 6 * 3600


def _summary(extra: dict[str, Column] | None) -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.max("at").alias("last"), *(c.alias(k) for k, c in (extra or {}).items())]


def sessions(events: DataFrame, gap: int = 1800, by: Sequence[str] = ("user_id",), at: str = "ts", cell: int = CELL) -> DataFrame:
    """(by, start, last, events): the sessions of each key; events ``gap`` seconds apart or more belong to different ones.

    Sessions are merged within cells of time first, by session windows; what is left of a key, a row for each of its sessions and cells, is merged across the borders of
    cells, so no task gets all events of a hot key. Rows without a time are left out; a null key is a key of its own. An empty table gives no session.
    """
    rows = events.select(*by, F.col(f"`{at}`").cast("timestamp").alias("at")).where("at IS NOT NULL")
    # the last microsecond of the gap is the window's, so an event exactly a gap later opens a new session
    window = F.session_window("at", f"{gap * 1_000_000 - 1} microseconds")
    within = rows.withColumn("cell", F.floor(F.unix_seconds("at") / cell)).groupBy(*by, "cell", window).agg(*_summary(None)).select(*by, F.col("session_window.start").alias("start"), "last", "events")
    order = Window.partitionBy(*by).orderBy("start")
    apart = F.unix_micros("start") - F.unix_micros(F.lag("last").over(order)) >= gap * 1_000_000
    island = F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return within.withColumn("island", island).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("events").alias("events")).drop("island")


def session_stream(events: DataFrame, gap: int = 1800, delay: str = "1 hour", by: Sequence[str] = ("user_id",), at: str = "ts") -> DataFrame:
    """As sessions(), of a stream, each when the watermark (``delay`` behind the latest event) has passed its end; later events of it are dropped."""
    rows = events.select(*by, F.col(f"`{at}`").cast("timestamp").alias("at")).withWatermark("at", delay)
    window = F.session_window("at", f"{gap * 1_000_000 - 1} microseconds")
    return rows.groupBy(*by, window).agg(*_summary(None)).select(*by, F.col("session_window.start").alias("start"), "last", "events")
