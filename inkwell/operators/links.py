"""Link audit: the links that documents show, and those among them that nobody allowed.

Links are taken out of HTML by expressions alone: tags first (comments, scripts and styles aside), then the attributes of each tag one after another, so that
what merely looks like a link inside another attribute's value is none. A Bloom filter of all allowed links lets those that are certainly foreign pass without a shuffle; only
the rest is compared with what its document allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.membership import maybe_in

# What is no markup, or one tag; one attribute of a tag with its value in quotes or bare.
HIDDEN = r"<!--[\s\S]*?(?:-->|$)|<script\b[\s\S]*?(?:</script\s*>|$)|<style\b[\s\S]*?(?:</style\s*>|$)"
TAG = r"<[a-zA-Z][^\s>/]*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"
#: Attributes that hold a link.
LINKED = ("href", "src")
# Entities by their characters; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def unescaped(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def html_links(html: Column) -> Column:
    """The values of href and src of a page's tags, in their order, entities resolved, blanks around them gone."""
    tokens = F.regexp_extract_all(html, F.lit(f"(?i)({HIDDEN}|{TAG})"), 1)
    shown = F.filter(tokens, lambda t: ~t.rlike(r"(?i)^<(?:!--|style\b)"))
    # of a script its own tag alone
    tags = F.transform(shown, lambda t: F.when(t.rlike(r"(?i)^<script\b"), F.regexp_extract(t, f"(?i)^({TAG})", 1)).otherwise(t))
    inside = lambda t: F.regexp_replace(t, r"^<[a-zA-Z][^\s>/]*|>$", "")
    attributes = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(inside(t), F.lit(f"({ATTRIBUTE})"), 1)))
    linked = F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).isin(*LINKED) & (F.regexp_extract(a, ATTRIBUTE, 2) != ""))
    return F.transform(linked, lambda a: F.trim(unescaped(F.regexp_replace(F.regexp_extract(a, ATTRIBUTE, 2), r"^([\"'])([\s\S]*)\1$", "$2"))))


def markdown_links(text: Column) -> Column:
    """The targets of a Markdown text's inline links and images, and of addresses in angle brackets or bare."""
    inline = F.regexp_extract_all(text, F.lit(r"\]\(\s*<?([^\s()<>]+(?:\([^\s()<>]*\)[^\s()<>]*)*)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)"), 1)
    rest = F.regexp_replace(text, r"\]\([^)]*\)", "]")
    bare = F.transform(F.regexp_extract_all(rest, F.lit(r"(?i)\b((?:https?|ftp)://[^\s<>\"')\]]+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.concat(inline, bare)


def links(documents: DataFrame, found: Column, by: str) -> DataFrame:
    """(by, link, times): the distinct links of each document."""
    return documents.select(by, F.explode(found).alias("link")).groupBy(by, "link").agg(F.count(F.lit(1)).alias("times"))


def foreign(found: DataFrame, allowed: DataFrame, by: str) -> DataFrame:
    """The rows of ``found`` (by, link, ...) whose link their document does not allow; allowed: (by, link). A null link is none; documents that allow nothing have foreign links alone."""
    listed = allowed.select(F.col(by).alias("of"), F.col("link").alias("listed")).where("listed IS NOT NULL")
    probed = maybe_in(found.where("link IS NOT NULL"), F.xxhash64(by, "link"), listed.select(F.xxhash64("of", "listed").alias("key")), "maybe")
    certain = probed.where("NOT maybe").drop("maybe")
    rest = probed.where("maybe").drop("maybe").join(listed, F.col(by).eqNullSafe(F.col("of")) & (F.col("link") == F.col("listed")), "left_anti")
    return certain.unionByName(rest)
