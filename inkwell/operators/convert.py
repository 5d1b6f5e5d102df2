"""Documents from source text to chapters: the normalisers in their order, mathematics, Markdown blocks, turns and chapters. Each step is DataFrame to DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import folds, text
from inkwell.operators.html import blocks_of

HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
OPENING = re.compile(r"^((?:\s|>)*)(`{3,}|~{3,})\s*([\w+-]*)")
ITEM = re.compile(r"(\s*)([-*+]|\d+\.)\s+(.*)$", re.S)
RULE = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*$")
TABLE = re.compile(r"\s*\|")
DIVIDER = re.compile(r"\s*\|?[\s:|-]+\|[\s:|-]*$")
QUOTE = re.compile(r" {0,3}>\s?(.*)$", re.S)

BLOCK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])


def markdown_blocks_of(source: str | None) -> list[dict]:
    """Ordered blocks (pos, tag, level, lang, line, text): h1-h6, p, li, oli, th, tr, pre, blockquote, hr; ``line`` is the first source line, from 1."""
    out: list[dict] = []
    loose: list[str] = []
    at = 0

    def put(tag: str, body: str, line: int, level: int = 0, lang: str | None = None) -> None:
        out.append({"pos": len(out), "tag": tag, "level": level, "lang": lang, "line": line, "text": body})

    def flush() -> None:
        if loose:
            put("p", "\n".join(loose), at)
            loose.clear()

    rows = (source or "").split("\n")
    k = 0
    while k < len(rows):
        row, number = rows[k], k + 1
        if m := OPENING.match(row):
            flush()
            body = []
            while k + 1 < len(rows):
                k += 1
                line = rows[k].lstrip("> \t") if m[1] else rows[k]
                if line.rstrip().startswith(m[2]) and not line.strip().strip(m[2][0]):
                    break
                body.append(rows[k][len(m[1]) :] if rows[k].startswith(m[1]) else rows[k])
            put("pre", "\n".join(body), number, lang=m[3] or None)
        elif not row.strip():
            flush()
        elif m := HEADING.match(row):
            flush()
            put(f"h{len(m[1])}", m[2], number, len(m[1]))
        elif RULE.match(row):
            flush()
            put("hr", "", number)
        elif m := ITEM.match(row):
            flush()
            put("li" if m[2] in "-*+" else "oli", m[3], number, len(m[1]) // 2 + 1)
        elif TABLE.match(row):
            flush()
            if DIVIDER.match(row):
                if out and out[-1]["tag"] == "tr":
                    out[-1]["tag"] = "th"
            else:
                put("tr", " | ".join(c.strip() for c in row.strip().strip("|").split("|")), number)
        elif m := QUOTE.match(row):
            flush()
            if out and out[-1]["tag"] == "blockquote" and out[-1]["line"] + out[-1]["text"].count("\n") + 1 == number:
                out[-1]["text"] += "\n" + m[1]
            else:
                put("blockquote", m[1], number)
        elif not loose and out and out[-1]["tag"] in ("li", "oli") and rows[k - 1].strip() and row[:1] == " ":
            out[-1]["text"] += "\n" + row.strip()
        else:
            if not loose:
                at = number
            loose.append(row.strip())
        k += 1
    flush()
    return out


@F.pandas_udf(T.ArrayType(BLOCK))
def markdown_blocks(source: pd.Series) -> pd.Series:
    return source.map(markdown_blocks_of)


@F.pandas_udf(T.ArrayType(BLOCK))
def _html_blocks(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [b | {"lang": None, "line": None} for b in blocks_of(s)])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("math", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("latex", T.StringType()), T.StructField("display", T.BooleanType())])))]))
def _protected(source: pd.Series) -> pd.DataFrame:
    made = [(None, None) if s is None else folds.protected(s) for s in source]
    return pd.DataFrame({"text": [t for t, _ in made], "math": [None if m is None else [dict(zip(("token", "latex", "display"), x, strict=True)) for x in m] for _, m in made]})


def normalised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` after the ten normalisers in their order, which is part of their meaning: fences are mended before the rules that look for them.

    Each rule is a projection of its own: a rule reads its text more than once, so nesting them in one expression would multiply it.
    """
    for rule in (text.front_matter, text.zero_width_fences, text.spaced_fences, folds.nest_lists, text.export_timestamps, text.metadata_breaks, text.paren_lists, text.hashtags, text.promoted_labels, text.blank_before_blocks):
        docs = _folded(docs, rule) if rule.__module__ == folds.__name__ else docs.withColumn("text", rule(F.col("text")))
    return docs


def _folded(docs: DataFrame, rule) -> DataFrame:
    """A line fold over Arrow batches. It also ends the projections before it, which the planner would otherwise merge with those behind it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[None if t is None else rule(t) for t in batch["text"]])

    return docs.mapInPandas(work, docs.schema)


def documents(raw: DataFrame) -> DataFrame:
    """(doc_id, format, text, math) of (doc_id, format, text): Markdown is normalised and its mathematics replaced by tokens; other formats stay."""
    kept = raw.select("doc_id", "format", "text")
    steps = normalised(kept.where("format = 'md'")).unionByName(kept.where("format <> 'md'"))
    both = steps.withColumn("p", _protected(F.when(F.col("format").isin("md", "txt"), F.col("text"))))
    return both.select("doc_id", "format", F.coalesce("p.text", "text").alias("text"), F.col("p.math").alias("math"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, level, lang, line, text) of documents."""
    kind = F.col("format")
    made = F.when(kind == "html", _html_blocks(F.when(kind == "html", F.col("text")))).otherwise(markdown_blocks(F.when(kind != "html", F.col("text"))))
    return docs.select("doc_id", F.explode(made).alias("b")).select("doc_id", "b.*")


def titles(raw: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, title): that given, else a leading h1 (the first heading of any level), else the file's name."""
    heads = found.where("tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')").groupBy("doc_id").agg(F.min_by("tag", "pos").alias("tag"), F.min_by("text", "pos").alias("head"))
    return raw.join(heads, "doc_id", "left").select("doc_id", F.coalesce("title", F.when(F.col("tag") == "h1", F.col("head")), F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"))


def chapter_pages(found: DataFrame, fallback: str) -> DataFrame:
    """(doc_id, chapter, title, xhtml): blocks as XHTML, a chapter from each h1."""
    from pyspark.sql.window import Window

    tag = F.when(F.col("tag").isin("li", "oli", "tr", "th", "hr"), "p").otherwise(F.col("tag"))
    body = F.concat(F.lit("<"), tag, F.lit(">"), text.escaped(text.safe_symbols(F.col("text"))), F.lit("</"), tag, F.lit(">"))
    numbered = found.withColumn("n", F.sum((F.col("tag") == "h1").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))).withColumn("x", body)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"])
    pages = numbered.groupBy("doc_id", "n").agg(F.max(F.when(F.col("tag") == "h1", F.col("text"))).alias("title"), F.array_join(rows, "\n").alias("xhtml"))
    return pages.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("chapter"), F.coalesce("title", F.lit(fallback)).alias("title"), "xhtml")
