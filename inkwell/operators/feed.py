"""Feed items: names, cleaning of show notes, and what is still to be delivered."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.functions.text import alnum, escaped, slug
from inkwell.operators.html import Node, parse

# An item's title, and the labels of its notes. A show's own slug prefix and boilerplate are parameters.
TITLE = r"(?U)^(?:[A-Z]+!\s+)?(.+?)(?:\.|\s+-)\s+Day\s+(\d+)\b"
PREFIX = "item"
BOILER = ("Podcast Homepage", "Reading Plan", "Contact Us", "Follow Us", "Website")
NOTES_LABEL = re.compile(r"Episode Notes:?$", re.I)
SECTION_LABEL = re.compile(r"(?:In Today['’]s Episode|Episode (?:Highlights|Overview)):?$", re.I)
SCRIPTURE = re.compile(r"Today['’]s Scripture:", re.I)
KEY_VERSE = re.compile(r"[\"“].+[\"”]\s*(?:[—–-]\s*)?(?:[1-3]\s)?[A-Z][a-z]+\s\d+:\d+(?:[–-]\d+)?\.?$")
MAX_SENDS = 5
DELIVERED, NOTHING, FLOOD = 0, 10, 4


def ref(title: Column) -> Column:
    return F.trim(F.regexp_extract(title, TITLE, 1))


def day(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, TITLE, 2), F.lit("")).cast("int")


def names(title: Column, prefix: str = PREFIX) -> Column:
    """struct(slug, display): by reference and day where the title has them, else from the title."""
    numbered = F.struct(F.concat(F.lit(f"{prefix}-day-"), F.format_string("%03d", day(title)), F.lit("-"), slug(ref(title))).alias("slug"), F.concat(ref(title), F.lit(" — Day "), day(title).cast("string")).alias("display"))
    plain = F.struct(F.concat(F.lit(f"{prefix}-"), F.regexp_replace(F.left(slug(title), F.lit(60)), "-+$", "")).alias("slug"), title.alias("display"))
    return F.when(title.rlike(TITLE), numbered).otherwise(plain)


def is_title_line(line: Column, title: Column) -> Column:
    """Whether a line repeats the item's title: same day and reference, else one is the other's beginning."""
    both = line.rlike(TITLE) & title.rlike(TITLE)
    a, b = alnum(line), alnum(title)
    return F.when(both, (day(line) == day(title)) & (alnum(ref(line)) == alnum(ref(title)))).otherwise((a != "") & (b.startswith(a) | a.startswith(b)))


def feed_order(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Oldest first within each feed; of items of one time the later in the feed is older. items: (guid, pub_date, feed_pos, by); without ``by`` they are one feed's, which holds some hundreds."""
    kept = items.where("guid IS NOT NULL AND trim(guid) <> ''")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("pub_date", F.desc("feed_pos"))))


def unseen(items: DataFrame, state: DataFrame) -> DataFrame:
    return items.join(state.select("guid"), "guid", "left_anti")


def oldest(items: DataFrame, n: int = 1) -> DataFrame:
    return items.orderBy("pub_date", F.desc("feed_pos")).limit(n)


def newest(items: DataFrame, n: int = 1) -> DataFrame:
    return items.orderBy(F.desc("pub_date"), "feed_pos").limit(n)


def next_delivery(items: DataFrame, state: DataFrame, max_sends: int = MAX_SENDS) -> DataFrame:
    """One row (status, unseen, guid): 10 where nothing is new, 4 and no item where over ``max_sends`` are, else 0 and the oldest."""
    left = unseen(items, state)
    found = left.agg(F.count(F.lit(1)).alias("unseen"), F.min_by("guid", F.struct("pub_date", -F.col("feed_pos"))).alias("guid"))
    status = F.when(F.col("unseen") == 0, NOTHING).when(F.col("unseen") > max_sends, FLOOD).otherwise(DELIVERED)
    return found.select(status.alias("status"), "unseen", F.when(status == DELIVERED, F.col("guid")).alias("guid"))


def seeded(items: DataFrame, state: DataFrame, leave: int, at: Column) -> DataFrame:
    """The state after all but the newest ``leave`` items are marked; those there already keep their mark."""
    left = newest(items, leave).select("guid")  # a top-k: no order over all items
    marked = items.join(left, "guid", "left_anti").select("guid", F.lit("seeded").alias("how"), at.alias("at"))
    return state.unionByName(marked.join(state.select("guid"), "guid", "left_anti"))


def marked(state: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by guid: the later mark holds."""
    return state.unionByName(new).groupBy("guid").agg(F.max_by("how", "at").alias("how"), F.max("at").alias("at"))


def _segments(node: Node) -> list[str]:
    out, now = [], []
    for x in node.children:
        if isinstance(x, Node) and x.tag == "br":
            out.append(" ".join("".join(now).split()))
            now = []
        else:
            now.append(x if isinstance(x, str) else "".join(x.strings()))
    return [*out, " ".join("".join(now).split())]


def clean_notes(html: str | None, title: str | None, boilerplate: tuple[str, ...] = BOILER) -> list[dict]:
    """Blocks (tag, text) of show notes without the title line, labels and boilerplate; section labels become h2, a key verse a blockquote."""
    out: list[dict] = []
    some = "(?:" + "|".join(map(re.escape, boilerplate)) + ")"
    boiler_line, boiler_inline = re.compile(some + r"\b", re.I), re.compile(r"\s" + some + ":")
    squash = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    pattern = re.compile(TITLE.replace("(?U)", ""))

    def same_title(line: str) -> bool:
        a, b = pattern.match(line), pattern.match(title or "")
        if a and b:
            return a[2] == b[2] and squash(a[1]) == squash(b[1])
        x, y = squash(line), squash(title)
        return bool(x) and (y.startswith(x) or x.startswith(y))

    seen_title = False
    for x in parse(html or "").children:
        if isinstance(x, Node) and x.tag in ("ul", "ol"):
            items = [" ".join("".join(li.strings()).split()) for li in x.children if isinstance(li, Node) and li.tag == "li"]
            out += [{"tag": "li", "text": t} for t in items if t and not boiler_line.match(t)]
            continue
        lines = [" ".join(x.split())] if isinstance(x, str) else _segments(x)
        kept = []
        for line in lines:
            if boiler_line.match(line):
                continue
            if SCRIPTURE.match(line) and (m := boiler_inline.search(line)):
                line = line[: m.start()]
            if not seen_title and line and same_title(line):
                seen_title = True
                continue
            kept.append(line)
        text = " ".join(k for k in kept if k)
        if not text or NOTES_LABEL.match(text):
            continue
        tag = "h2" if SECTION_LABEL.match(text) else "blockquote" if KEY_VERSE.match(text) else x.tag if isinstance(x, Node) and x.tag in ("h2", "h3", "blockquote") else "p"
        out.append({"tag": tag, "text": text})
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("tag", T.StringType()).add("text", T.StringType())))
def notes(html: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([clean_notes(h, t) for h, t in zip(html, title, strict=True)])


def document(display: Column, image: Column, blocks: Column, link: Column, date: Column) -> Column:
    """The item's HTML document: heading, cover, notes, and a footer with link and date."""
    body = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<"), b["tag"], F.lit(">"), escaped(b["text"]), F.lit("</"), b["tag"], F.lit(">"))), "\n")
    cover = F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit('<img src="'), image, F.lit('"/>')))
    foot = F.concat(F.lit('<p><a href="'), link, F.lit('">'), escaped(link), F.lit("</a> · "), F.date_format(date, "d MMMM yyyy"), F.lit("</p>"))
    return F.concat_ws("\n", F.concat(F.lit("<h1>"), escaped(display), F.lit("</h1>")), cover, body, foot)
