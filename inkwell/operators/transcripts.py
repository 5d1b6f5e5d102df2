"""Question and answer turns, and chapters, as running counts over ordered blocks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKER = r"(?i)^\s*(question|answer|prompt|response)\s*:?\s*$"


def marker_kind(tag: Column, text: Column) -> Column:
    """question or answer for a paragraph or an h2-h6 that is only such a word, else null."""
    word = F.lower(F.regexp_extract(text, MARKER, 1))
    return F.when(tag.isin("p", "h2", "h3", "h4", "h5", "h6"), F.when(word.isin("question", "prompt"), "question").when(word.isin("answer", "response"), "answer"))


def turns(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, turn, kind, round, label, members): a turn runs to the next marker or h1. An answer before any question has no number. blocks: (by, pos, tag, text)."""
    order = Window.partitionBy(by).orderBy("pos")
    marked = blocks.withColumn("kind", marker_kind(F.col("tag"), F.col("text")))
    marked = marked.withColumn("round", F.sum((F.col("kind") == "question").cast("int")).over(order)).withColumn("opens", (F.col("kind").isNotNull() | (F.col("tag") == "h1")).cast("int"))
    grouped = marked.withColumn("group", F.sum("opens").over(order)).groupBy(by, "group")
    found = grouped.agg(F.min_by("kind", "pos").alias("kind"), F.min_by(F.coalesce("round", F.lit(0)), "pos").alias("round"), (F.count(F.lit(1)) - 1).alias("members")).where("kind IS NOT NULL")
    label = F.concat(F.initcap("kind"), F.when(F.col("round") > 0, F.concat(F.lit(" "), F.col("round").cast("string"))).otherwise(""))
    return found.select(by, F.row_number().over(Window.partitionBy(by).orderBy("group")).alias("turn"), "kind", "round", label.alias("label"), "members")


def chapters(blocks: DataFrame, fallback: str, by: str = "doc_id") -> DataFrame:
    """(by, chapter, title, blocks): an h1 opens a chapter; what stands before the first one has the fallback title."""
    order = Window.partitionBy(by).orderBy("pos")
    numbered = blocks.withColumn("n", F.sum((F.col("tag") == "h1").cast("int")).over(order))
    found = numbered.groupBy(by, "n").agg(F.max(F.when(F.col("tag") == "h1", F.col("text"))).alias("title"), F.count(F.lit(1)).alias("blocks"))
    return found.select(by, F.row_number().over(Window.partitionBy(by).orderBy("n")).alias("chapter"), F.coalesce("title", F.lit(fallback)).alias("title"), "blocks")
