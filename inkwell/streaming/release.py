"""Feeds as keyed state: unseen items wait in the state of their feed and are released one at a time, oldest first, by a timer.

At each tick, ``period`` seconds apart in event time, a feed that has unseen items published before the tick releases the oldest. With more than ``max_sends`` of them it
releases nothing from then on, until it is seeded: a flood. All of it depends on event time alone, so however the stream is cut into batches, and wherever it was
killed and started again, the released rows are the same. State is a key-value store with a changelog: a batch writes what it changed, never the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkwell.operators.feed import DELIVERED, FLOOD, MAX_SENDS

PERIOD = 6 * 3600
RELEASED = "feed string, tick timestamp, status int, unseen long, guid string, pub_date timestamp"
#: What may come in: items, and the command to take all that a feed has waiting as seen.
ITEM, SEED = "item", "seed"


class Release(StatefulProcessor):
    """State of a feed: what waits, by guid, what has been seen, and the last tick. Times are microseconds."""

    def __init__(self, period: int, max_sends: int | None) -> None:
        self.period, self.max_sends = period, max_sends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "guid string", "at long, pos long")
        self.seen = handle.getMapState("seen", "guid string", "how string")
        self.feed = handle.getValueState("feed", "next long, flooded boolean")

    def _tick_after(self, at: int) -> int:
        """The first tick after a time: an item waits for the end of the period that it was published in."""
        size = self.period * 1_000_000
        return (at // size + 1) * size

    def _timer(self, tick: int | None, flooded: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if tick is None:
            self.feed.update((-1, flooded))
            return
        self.feed.update((tick, flooded))
        if not flooded:
            self.handle.registerTimer(tick // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.feed.get() if self.feed.exists() else (-1, False)
        tick, flooded = (None if state[0] < 0 else state[0]), state[1]
        for batch in rows:
            for what, guid, at, pos in zip(batch["what"], batch["guid"], batch["at"], batch["pos"], strict=True):
                if what == SEED:
                    for (waits,) in list(self.waiting.keys()):
                        self.seen.updateValue((waits,), ("seeded",))
                        self.waiting.removeKey((waits,))
                    tick, flooded = None, False
                elif not self.seen.containsKey((guid,)) and not self.waiting.containsKey((guid,)):
                    self.waiting.updateValue((guid,), (int(at), int(pos)))
                    tick = self._tick_after(int(at)) if tick is None else min(tick, self._tick_after(int(at)))
        self._timer(tick, flooded)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        tick = self.feed.get()[0]
        # a feed waits for few items more than max_sends, or it is flooded
        held = sorted((at, -pos, guid) for (guid,), (at, pos) in self.waiting.iterator())
        out, flooded = [], False
        while held and tick <= passed:
            due = sum(at < tick for at, _, _ in held)
            if not due:
                tick = self._tick_after(held[0][0])
                continue
            if self.max_sends is not None and due > self.max_sends:
                out.append((key[0], tick, FLOOD, due, None, None))
                flooded = True
                break
            at, _, guid = held.pop(0)
            self.seen.updateValue((guid,), ("sent",))
            self.waiting.removeKey((guid,))
            out.append((key[0], tick, DELIVERED, due, guid, at))
            tick += self.period * 1_000_000
        self._timer(tick if out or held else None, flooded)
        if out:
            feed, ticks, status, unseen, guids, ats = zip(*out, strict=True)
            yield pd.DataFrame({"feed": feed, "tick": pd.to_datetime(list(ticks), unit="us"), "status": pd.array(status, "int32"), "unseen": pd.array(unseen, "int64"), "guid": pd.Series(guids, dtype=object), "pub_date": pd.to_datetime(pd.Series(ats, dtype="Int64"), unit="us")})

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in a store on disk, with a changelog for each batch. A stream must be read in it."""
    own = spark.newSession()
    for key, value in (("providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"), ("rocksdb.changelogCheckpointing.enabled", "true")):
        own.conf.set(f"spark.sql.streaming.stateStore.{key}", value)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # a stream keeps the number that it began with
    return own


def released(items: DataFrame, period: int = PERIOD, max_sends: int | None = MAX_SENDS, delay: str = "1 hour") -> DataFrame:
    """A stream (feed, tick, status, unseen, guid, pub_date) of a stream (feed, what, guid, pub_date, feed_pos), to be written in append mode.

    what: item, or seed (which marks all that waits). An item that comes again is no new one. Items later than the watermark, ``delay`` behind the latest item, may
    be released late; of items of one time the later in the feed is older. Items without a feed, guid or time are left out.
    """
    rows = items.where("feed IS NOT NULL AND pub_date IS NOT NULL AND (what = 'seed' OR guid IS NOT NULL)").withColumn("pub_date", F.col("pub_date").cast("timestamp"))
    rows = rows.withWatermark("pub_date", delay).select("feed", "what", "guid", "pub_date", F.unix_micros("pub_date").alias("at"), F.coalesce("feed_pos", F.lit(0)).cast("long").alias("pos"))
    return rows.groupBy("feed").transformWithStateInPandas(Release(period, max_sends), RELEASED, "append", "EventTime")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is now to the Parquet table at ``path``, each batch once: the table's own log tells which batches are in it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
