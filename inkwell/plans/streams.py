"""Queries that run as streams over the events, or change a table of states: what they leave is read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import sessions
from inkwell.plans.lineage import folder
from inkwell.plans.ranges import SQL_SESSIONS
from inkwell.plans.registry import query, table
from inkwell.sources import commits
from inkwell.streaming import release


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. A pattern may be one file or a folder; a plain path must be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends to a table, once all that is there now has been read."""
    at = folder(spark, name)
    release.write(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


@query(SQL_SESSIONS + """
    , w AS (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 AS mark FROM events)
    SELECT user_id, start::VARCHAR AS start, last::VARCHAR AS last, events FROM s, w WHERE epoch_us(last) + 1800000000 <= mark
""")
def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream has closed: those that ended before its watermark."""
    own = release.stateful(spark)
    found = _run(spark, sessions.session_stream(_events(own, sf_dir)), "sessions")
    return found.withColumns({c: F.col(c).cast("string") for c in ("start", "last")})


_PERIOD, _MOST = 21_600, 5


@query(f"""
    WITH i AS (SELECT user_id::VARCHAR AS feed, event_id, ts, epoch_us(ts) // {_PERIOD * 1_000_000} + 1 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id DESC) AS n FROM events),
    r AS (SELECT *, n + max(k - n) OVER (PARTITION BY feed ORDER BY n) AS tick FROM i),
    q AS (SELECT a.feed, a.k, max(a.n) - (SELECT count(*) FROM r AS b WHERE b.feed = a.feed AND b.tick < a.k) AS waiting FROM r AS a GROUP BY a.feed, a.k),
    f AS (SELECT feed, min(k) AS tick, arg_min(waiting, k) AS waiting FROM q WHERE waiting > {_MOST} GROUP BY feed),
    w AS (SELECT (epoch_ms(max(ts)) - 3600000) // {_PERIOD * 1000} AS mark FROM events),
    u AS (
        SELECT r.feed, r.tick, 0 AS status, (SELECT count(*) FROM r AS b WHERE b.feed = r.feed AND b.k <= r.tick) - r.n + 1 AS unseen, r.event_id::VARCHAR AS guid, r.ts AS pub_date
        FROM r LEFT JOIN f ON f.feed = r.feed WHERE f.tick IS NULL OR r.tick < f.tick
        UNION ALL SELECT feed, tick, 4, waiting, NULL, NULL FROM f
    )
    SELECT feed, (TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (tick * {_PERIOD}))::VARCHAR AS tick, status::INTEGER AS status, unseen, guid, pub_date::VARCHAR AS pub_date FROM u, w WHERE tick <= mark
""")
def feed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of a feed a user: one is released every six hours, the oldest first; a feed with more than five waiting is flooded and stops."""
    own = release.stateful(spark)
    items = _events(own, sf_dir).select(F.col("user_id").cast("string").alias("feed"), F.lit(release.ITEM).alias("what"), F.col("event_id").cast("string").alias("guid"), F.col("ts").alias("pub_date"), F.col("event_id").alias("feed_pos"))
    found = _run(spark, release.released(items, _PERIOD, _MOST), "releases")
    return found.withColumns({c: F.col(c).cast("string") for c in ("tick", "pub_date")})


_STATE, _WRITERS = "user_id bigint, n bigint, latest bigint", 4


@query("SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events GROUP BY user_id")
def state_of_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by user in one table of states, by writers at once, each of which adds its share to what it reads: a lost update would show."""
    at = folder(spark, "state")
    events = table(spark, sf_dir, "events")

    def add(writer: int) -> int:
        own = events.where(F.col("event_id") % _WRITERS == writer).groupBy("user_id").agg(F.count(F.lit(1)).alias("more"), F.max("event_id").alias("new"))
        return commits.update(spark, at, ["user_id"], _STATE, lambda old: own.join(old, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), F.greatest("latest", "new").alias("latest")))

    with ThreadPoolExecutor(_WRITERS) as pool:
        list(pool.map(add, range(_WRITERS)))
    commits.compact(spark, at, ["user_id"], _STATE, 2)
    return commits.rows(spark, at, ["user_id"], _STATE)
