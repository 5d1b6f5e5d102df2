"""The feed as a stream: unseen items are delivered oldest first, at least once, and the state is written after the sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.feed import MAX_SENDS, unseen
from inkwell.sources import commits

STATE = "guid string, how string, at timestamp"


def deliver(items: DataFrame, state_path: str, checkpoint: str, sink: Callable[[DataFrame], None], max_sends: int | None = MAX_SENDS) -> StreamingQuery:
    """``items``: a stream of (guid, pub_date, ...). A batch of over ``max_sends`` unseen items is an error and delivers nothing; null: no limit.

    The state, a table of commits, gets the marks of new items alone; it is merged once there are many. A stream for many feeds is in release.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        known = commits.rows(spark, state_path, ["guid"], STATE)
        new = unseen(rows.dropDuplicates(["guid"]), known).persist()
        try:
            count = new.count()
            if max_sends is not None and count > max_sends:
                raise ValueError(f"{count} unseen items exceed {max_sends}")
            if count:
                sink(new.orderBy("pub_date"))
                commits.change(new.select("guid", F.lit("sent").alias("how"), F.current_timestamp().alias("at")), state_path, ["guid"])
                commits.compact(spark, state_path, ["guid"], STATE)
        finally:
            new.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
