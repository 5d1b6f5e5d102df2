"""Queries that join ranges of time, boxes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import ranges, sessions
from inkwell.plans.registry import query, table


@query("""
    WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
    SELECT day::VARCHAR AS day, count(*) AS under_way, sum(l_quantity)::BIGINT AS quantity
    FROM d JOIN lineitem ON day BETWEEN l_shipdate::DATE AND l_shipdate::DATE + l_quantity::INTEGER GROUP BY day
""")
def goods_under_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under way on each day on which something was ordered: each is for as many days as its quantity."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    items = table(spark, sf_dir, "lineitem").select("l_quantity", F.to_date("l_shipdate").alias("start")).withColumn("end", F.date_add("start", F.col("l_quantity").cast("int")))
    found = ranges.covered(days, items, "day", "start", "end")
    return found.groupBy(F.col("left.day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("under_way"), F.sum("right.l_quantity").cast("long").alias("quantity"))


@query("""
    WITH i AS (SELECT o_orderkey, o_custkey, o_orderdate AS start, o_orderdate + INTERVAL 1 DAY * (7 + o_orderkey % 90) AS stop FROM orders)
    SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order, a.o_custkey AS customer FROM i AS a JOIN i AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.start < b.stop AND b.start < a.stop
""")
def orders_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of a customer that are open at the same time; an order's end does not belong to it."""
    days = F.make_dt_interval(F.lit(7) + (F.col("o_orderkey") % 90).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + days).alias("stop"))
    pairs = ranges.overlapping(orders, orders, [("start", "stop")], [("start", "stop")], ["o_custkey"], closed=False).where("left.o_orderkey < right.o_orderkey")
    return pairs.select(F.col("left.o_orderkey").alias("first_order"), F.col("right.o_orderkey").alias("second_order"), F.col("left.o_custkey").alias("customer"))


_SQL_BOXES = "(SELECT l_suppkey AS page, l_returnflag, (l_partkey * 37 % 600)::DOUBLE AS x0, (l_orderkey * 13 % 800)::DOUBLE AS y0, l_partkey * 37 % 600 + l_quantity * 3 AS x1, l_orderkey * 13 % 800 + 4 + l_linenumber * 6.0 AS y1 FROM lineitem)"


@query(f"""
    WITH b AS (SELECT * FROM {_SQL_BOXES}), p AS (
        SELECT a.page, least(a.x1, t.x1) - greatest(a.x0, t.x0) AS w, least(a.y1, t.y1) - greatest(a.y0, t.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS area
        FROM b AS a JOIN b AS t ON a.page = t.page AND t.l_returnflag = 'R' AND a.x0 <= t.x1 AND t.x0 <= a.x1 AND a.y0 <= t.y1 AND t.y0 <= a.y1
    ) SELECT page, count(*) AS pairs, sum(w * h)::BIGINT AS shared FROM p WHERE w * h > 0.5 * area GROUP BY page
""")
def boxes_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of line items, a page a supplier: how many pairs there are of a box and a returned item's box that covers over half of it, and the area they share."""
    x, y = F.col("l_partkey") * 37 % 600, F.col("l_orderkey") * 13 % 800
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_returnflag", x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity") * 3).alias("x1"), (y + 4 + F.col("l_linenumber") * 6.0).alias("y1"))
    found = ranges.box_overlaps(boxes, boxes.where("l_returnflag = 'R'"), ["page"])
    side = lambda a, b: F.least(F.col("left")[b], F.col("right")[b]) - F.greatest(F.col("left")[a], F.col("right")[a])
    return found.groupBy(F.col("left.page").alias("page")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(side("x0", "x1") * side("y0", "y1")).cast("long").alias("shared"))


SQL_SESSIONS = """
    WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    s AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM i GROUP BY user_id, k)
"""


@query(SQL_SESSIONS + "SELECT user_id, start::VARCHAR AS start, last::VARCHAR AS last, events FROM s")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "events")).withColumns({c: F.col(c).cast("string") for c in ("start", "last")})
