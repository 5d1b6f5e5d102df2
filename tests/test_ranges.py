import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import ranges, sessions


def _brute(left, right, closed, by=True):
    meets = (lambda a, b, c, d: a <= d and c <= b) if closed else (lambda a, b, c, d: a < d and c < b)
    return sorted((i, j) for i, k, a, b in left for j, m, c, d in right if None not in (a, b, c, d) and a <= b and c <= d and (not by or (k is not None and k == m)) and meets(a, b, c, d))


@pytest.mark.parametrize("closed", [True, False])
def test_overlaps_of_all_lengths(spark, closed):
    """Points, short and very long ranges, negative places, ends that touch, nulls and ends before starts, repeated rows, a hot place; one pair once."""
    rng = random.Random(1)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randrange(-500, 500)
            out.append((i, rng.choice(["x", "y", None]), a, a + rng.choice([0, 0, 1, 5, 40, 300, 100_000])))
        return out + [(n, "x", None, 5), (n + 1, "x", 3, None), (n + 2, "x", 9, 2)] + [(n + 3, "y", 7, 7)] * 40

    left, right = some(120), some(100)
    schema = "i int, k string, a long, b long"
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = ranges.overlapping(one, two, [("a", "b")], [("a", "b")], ["k"], closed)
    assert sorted((r.left.i, r.right.i) for r in got.collect()) == _brute(left, right, closed)
    if closed:
        assert sorted((r.left.i, r.right.i) for r in ranges.overlapping(one, two, [("a", "b")], [("a", "b")]).collect()) == _brute(left, right, True, False)


def test_times_dates_and_plan(spark):
    day = dt.date(2024, 2, 28)
    days = spark.createDataFrame([(day + dt.timedelta(days=k),) for k in range(5)], "day date")
    spans = spark.createDataFrame([("a", day, day + dt.timedelta(days=2)), ("b", day + dt.timedelta(days=4), day + dt.timedelta(days=400))], "name string, start date, end date")
    got = ranges.covered(days, spans, "day", "start", "end")
    assert sorted((r.left.day.isoformat(), r.right.name) for r in got.collect()) == [("2024-02-28", "a"), ("2024-02-29", "a"), ("2024-03-01", "a"), ("2024-03-03", "b")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    moments = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0, 1),)], "at timestamp")
    spans = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1))], "s timestamp, e timestamp")
    assert ranges.covered(moments, spans, "at", "s", "e").count() == 1
    assert ranges.covered(moments.limit(0), spans, "at", "s", "e").count() == 0 and ranges.covered(moments, spans.limit(0), "at", "s", "e").count() == 0


def test_hot_cells_are_split(spark):
    """All rows in one cell: both sides are parted, and every pair is there."""
    one = spark.range(3000).select(F.lit("k").alias("k"), F.lit(5).cast("long").alias("at"), "id")
    two = spark.range(20).select(F.lit("k").alias("k"), F.lit(0).cast("long").alias("s"), F.lit(9).cast("long").alias("e"), F.col("id").alias("n"))
    got = ranges.covered(one, two, "at", "s", "e", ["k"])
    assert got.count() == 60_000 and got.select("left.id", "right.n").distinct().count() == 60_000


def test_boxes_against_all_pairs(spark):
    rng = random.Random(2)
    box = lambda i, big: (i, rng.choice([1, 2]), *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.0, 3.0, 20.0, big]), rng.choice([2.0, 10.0, big])))
    one, two = [box(i, 30.0) for i in range(80)], [box(i, 90.0) for i in range(40)]
    schema = "i int, page int, x0 double, y0 double, x1 double, y1 double"
    got = ranges.box_overlaps(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["page"], 0.4)

    def share(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        area = (a[4] - a[2]) * (a[5] - a[3])
        return w * h / area if area > 0 and w > 0 and h > 0 else 0

    assert sorted((r.left.i, r.right.i) for r in got.collect()) == sorted((a[0], b[0]) for a in one for b in two if a[1] == b[1] and share(a, b) > 0.4)


def _islands(rows, gap):
    out, by = [], {}
    for user, at in rows:
        if at is not None:
            by.setdefault(user, []).append(at)
    for user, times in by.items():
        now = []
        for t in sorted(times):
            if now and (t - now[-1]).total_seconds() >= gap:
                out.append((user, now[0], now[-1], len(now)))
                now = []
            now.append(t)
        out.append((user, now[0], now[-1], len(now)))
    return sorted(out, key=str)


def test_sessions_across_cells(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1, 5, 50)
    rows = [(rng.choice([1, 2, None]), start + dt.timedelta(seconds=rng.randrange(0, 90_000))) for _ in range(150)]
    rows += [(7, start + dt.timedelta(seconds=600 * k)) for k in range(60)]  # exactly the gap apart, over several cells
    rows += [(8, start + dt.timedelta(seconds=599 * k)) for k in range(60)] + [(8, None), (9, start), (9, start)]
    got = sessions.sessions(spark.createDataFrame(rows, "user_id int, ts timestamp"), 600, cell=3600)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _islands(rows, 600)
    assert sessions.sessions(spark.createDataFrame([], "user_id int, ts timestamp")).count() == 0


def test_session_stream_with_late_events(spark, tmp_path):
    """Over several batches, with a restart between them; an event behind the watermark is dropped, one within it joins its session."""
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    schema, source = "user_id int, ts timestamp", str(tmp_path / "in")
    from inkwell.streaming.release import write

    for batch in ([(1, at(0)), (1, at(5)), (2, at(1))], [(1, at(9)), (1, at(60))], [(2, at(2)), (1, at(62)), (1, at(300))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = sessions.session_stream(spark.readStream.schema(schema).parquet(source), 600, "20 minutes")
        write(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, at(0), at(9), 3), (1, at(60), at(62), 2), (2, at(1), at(1), 1)]
