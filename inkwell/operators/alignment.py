"""Where the lines of a changed text stand in its source.

Lines that occur once in both texts, and in the same order, are anchors. Between two anchors, the k-th occurrence of a line in the result is the k-th in the source. So a change
that puts lines in, takes some away or writes some anew shifts nothing beyond the next anchor. Lines meet by document and hash, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(documents: DataFrame, by: str, text: Column, pos: str) -> DataFrame:
    """(by, pos, key): lines by number, with a hash of the line without blanks at its end."""
    return documents.select(by, F.posexplode(F.split(text, "\n", -1)).alias(pos, "line")).select(by, pos, F.xxhash64(F.regexp_replace("line", r"\s+$", "")).alias("key"))


def _anchors(source: DataFrame, result: DataFrame, by: str) -> DataFrame:
    """(by, at, source_at): lines alone of their kind in both texts, where the source's order is that of the result: none before is later there, and none behind earlier."""
    once = lambda df, pos: df.groupBy(by, "key").agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    both = once(source, "source_at").join(once(result, "at"), [by, "key"])
    order = Window.partitionBy(by).orderBy("at")
    before = F.max("source_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min("source_at").over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = both.withColumn("before", before).withColumn("behind", behind)
    return placed.where((F.col("before").isNull() | (F.col("before") < F.col("source_at"))) & (F.col("behind").isNull() | (F.col("behind") > F.col("source_at")))).select(by, "at", "source_at")


def _between(lines: DataFrame, anchors: DataFrame, by: str, pos: str) -> DataFrame:
    """Lines with the number of anchors up to them, and which occurrence of its kind since the last anchor each is."""
    marks = anchors.select(by, F.col(pos), F.lit(1).alias("mark"))
    gap = F.sum(F.coalesce("mark", F.lit(0))).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    found = lines.join(marks, [by, pos], "left").withColumn("gap", gap).drop("mark")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(by, "gap", "key").orderBy(pos)))


def source_lines(documents: DataFrame, by: str, source: str, result: str) -> DataFrame:
    """(by, line, source_line), both from 1: each line of ``result`` with the line of ``source`` that it was; null where it is new.

    Blanks at the end of a line do not count. A null text has no lines. Documents need distinct ids.
    """
    texts = documents.select(by, F.col(source).alias("source"), F.col(result).alias("result"))
    old, new = _lines(texts, by, F.col("source"), "source_at"), _lines(texts, by, F.col("result"), "at")
    anchors = _anchors(old, new, by)
    there, here = _between(old, anchors, by, "source_at"), _between(new, anchors, by, "at")
    found = here.join(there, [by, "gap", "key", "nth"], "left")
    return found.select(by, (F.col("at") + 1).alias("line"), (F.col("source_at") + 1).alias("source_line"))


def block_lines(blocks: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """``blocks`` (by, line, ...), found in a changed text, with ``source_line``: that of their first line that has one, from source_lines(); size lines are looked at."""
    at = blocks.withColumn("of_line", F.explode(F.sequence(F.col("line"), F.col("line") + F.greatest(F.col("size"), F.lit(1)) - 1)))
    known = lines.where("source_line IS NOT NULL").select(F.col(by).alias("of"), F.col("line").alias("at"), "source_line")
    first = at.join(known, (F.col(by) == F.col("of")) & (F.col("of_line") == F.col("at")), "left")
    return first.groupBy(*blocks.columns).agg(F.min_by("source_line", F.when(F.col("source_line").isNotNull(), F.col("of_line"))).alias("source_line"))
