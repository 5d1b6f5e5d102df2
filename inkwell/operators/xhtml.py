"""Documents as XHTML blocks: headings, paragraphs, nested lists, tables, code and quotes with what stands inside a line; one block a row, in order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.functions.text import safe_symbols, versioned_title, zero_width_fences
from inkwell.operators.convert import markdown_blocks_of
from inkwell.operators.html import CONTAINERS, SILENT, Node, parse

# Inline elements by what they become, headings that stay headings, elements that are blocks.
INLINE = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "code": "code", "kbd": "code", "sub": "sub", "sup": "sup", "u": "u", "s": "s", "del": "s"}
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table pre blockquote hr".split()) | (CONTAINERS - {""})


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _nodes(node: Node) -> Iterator[Node]:
    return (c for c in node.children if isinstance(c, Node))


def _image(node: Node) -> str:
    source = node.attrs.get("src", "").strip()
    return f'<img class="content-img" src="{escape(source)}" alt="{escape(node.attrs.get("alt", ""))}"/>' if source else escape(node.attrs.get("alt", ""), quote=False)


def inline(children: list) -> str:
    """What stands in a line: text escaped, emphasis, code, links with a target, breaks and images; other elements by what is in them."""
    out: list[str] = []
    for x in children:
        if isinstance(x, str):
            out.append(escape(_flat(x), quote=False))
        elif x.tag in SILENT:
            continue
        elif x.tag == "br":
            out.append("<br/>")
        elif x.tag == "img":
            out.append(_image(x))
        elif x.tag == "a" and x.attrs.get("href"):
            out.append(f'<a href="{escape(x.attrs["href"])}">{inline(x.children)}</a>')
        elif x.tag in INLINE:
            out.append(f"<{INLINE[x.tag]}>{inline(x.children)}</{INLINE[x.tag]}>")
        else:
            out.append(inline(x.children))
    return "".join(out)


def _holds_block(node: Node) -> bool:
    return any(n is not node and n.tag in BLOCKS for n in node.walk())


def _cell(node: Node) -> str:
    spans = "".join(f' {a}="{node.attrs[a]}"' for a in ("colspan", "rowspan") if node.attrs.get(a, "").isdigit() and node.attrs[a] != "1")
    body = "".join(x for _, x in flow(node.children)) if _holds_block(node) else inline(node.children).strip()
    return f"<{node.tag}{spans}>{body}</{node.tag}>"


def _table(node: Node) -> str:
    rows = [[c for c in _nodes(r) if c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    lines = ["<tr>" + "".join(map(_cell, r)) + "</tr>" for r in rows]
    head = 1 if rows and all(c.tag == "th" for c in rows[0]) else 0
    return "<table>" + (f"<thead>{lines[0]}</thead>" if head else "") + "<tbody>" + "".join(lines[head:]) + "</tbody></table>"


def _item(node: Node) -> str:
    """A list item: what stands in the line first, then the blocks in it; its one paragraph is no block of its own."""
    parts = flow(node.children)
    return "<li>" + "".join(x[3:-4] if tag == "p" and (k == 0 or len(parts) == 1) and x.startswith("<p>") else x for k, (tag, x) in enumerate(parts)) + "</li>"


def _list(node: Node) -> str:
    start = node.attrs.get("start", "") if node.tag == "ol" else ""
    first = f' start="{int(start)}"' if start.isdigit() and int(start) != 1 else ""
    return f"<{node.tag}{first}>" + "".join(_item(n) for n in _nodes(node) if n.tag == "li") + f"</{node.tag}>"


def _code(node: Node) -> str:
    return "<pre><code>" + escape("".join(node.strings()).strip("\n"), quote=False) + "</code></pre>"


RENDER: dict[str, Callable[[Node], str]] = {
    "ul": _list,
    "ol": _list,
    "table": _table,
    "pre": _code,
    "hr": lambda n: "<hr/>",
    "blockquote": lambda n: "<blockquote>" + "".join(x for _, x in flow(n.children)) + "</blockquote>",
    **{h: (lambda n: f"<{n.tag}>{inline(n.children).strip()}</{n.tag}>") for h in HEADINGS},
}


def flow(children: list) -> list[tuple[str, str]]:
    """(tag, XHTML) blocks: what stands in lines between blocks becomes a paragraph; unknown wrappers, h5 and h6 are gone into."""
    out: list[tuple[str, str]] = []
    loose: list = []

    def flush() -> None:
        if body := inline(loose).strip():
            out.append(("p", f"<p>{body}</p>"))
        loose.clear()

    for x in children:
        if isinstance(x, str) or x.tag not in BLOCKS and not _holds_block(x):
            loose.append(x)
            continue
        flush()
        if x.tag in RENDER:
            out.append((x.tag, RENDER[x.tag](x)))
        else:
            out += flow(x.children)
    flush()
    return out


# Markdown: blocks become the same tree


CODE_SPAN = re.compile(r"(`+)(.+?)\1")
LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)")
BARE = re.compile(r"(?<![\"'>=/\w])(https?://[^\s<>]*[^\s<>.,;:!?)\]'\"])")
STRONG, EMPHASIS = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S), re.compile(r"(?<![\w*])([*_])(?=[^\s*_])(.+?)(?<=[^\s*_])\1(?![\w*])", re.S)


def markdown_inline(text: str) -> str:
    """A line of Markdown as HTML. Code is set aside first, so that nothing inside it is read."""
    kept: list[str] = []

    def keep(html: str) -> str:
        kept.append(html)
        return f"\x00{len(kept) - 1}\x00"

    text = CODE_SPAN.sub(lambda m: keep(f"<code>{escape(m[2].strip(), quote=False)}</code>"), text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+.!-])", lambda m: keep(escape(m[1], quote=False)), text)
    text = re.sub(r"<(https?://[^>\s]+)>", lambda m: keep(f'<a href="{escape(m[1])}">{escape(m[1], quote=False)}</a>'), text)
    text = escape(text, quote=False)
    text = LINK.sub(lambda m: keep(f'<img src="{escape(m[3])}" alt="{escape(m[2])}"/>') if m[1] else keep(f'<a href="{m[3].replace(chr(34), "&quot;")}">') + m[2] + keep("</a>"), text)
    text = BARE.sub(lambda m: keep(f'<a href="{m[1]}">{m[1]}</a>'), text)
    text = EMPHASIS.sub(r"<em>\2</em>", STRONG.sub(r"<strong>\2</strong>", text))
    text = re.sub(r" {2,}\n", "<br/>", text)
    while "\x00" in text and kept:
        text, old = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text), text
        if text == old:
            break
    return text


def markdown_html(source: str | None) -> str:
    """Markdown as HTML, from its blocks: items nest by their depth, rows of a table stand together."""
    out: list[str] = []
    open_: list[str] = []  # lists that are open, outermost first
    rows: list[str] = []

    def close(depth: int) -> None:
        while len(open_) > depth:
            out.append(f"</li></{open_.pop()}>")

    def end_table() -> None:
        if rows:
            out.append("<table>" + "".join(rows) + "</table>")
            rows.clear()

    for b in markdown_blocks_of(source):
        tag, text = b["tag"], b["text"]
        if tag in ("tr", "th"):
            close(0)
            cell = "th" if tag == "th" else "td"
            rows.append("<tr>" + "".join(f"<{cell}>{markdown_inline(c)}</{cell}>" for c in text.split(" | ")) + "</tr>")
            continue
        end_table()
        if tag in ("li", "oli"):
            kind, depth = "ul" if tag == "li" else "ol", min(b["level"], len(open_) + 1)
            close(depth)
            if len(open_) == depth and open_[-1] != kind:
                close(depth - 1)
            if len(open_) == depth:
                out.append("</li>")
            else:
                open_.append(kind)
                out.append(f"<{kind}>")
            out.append(f"<li>{markdown_inline(text)}")
            continue
        close(0)
        if tag == "pre":
            out.append(f"<pre>{escape(text, quote=False)}</pre>")
        elif tag == "hr":
            out.append("<hr/>")
        elif tag == "blockquote":
            out.append("<blockquote>" + "".join(f"<p>{markdown_inline(p)}</p>" for p in re.split(r"\n\s*\n", text) if p.strip()) + "</blockquote>")
        else:
            out.append(f"<{tag}>{markdown_inline(text)}</{tag}>")
    end_table()
    close(0)
    return "\n".join(out)


def plain_html(text: str | None) -> str:
    parts = [p.strip("\n") for p in re.split(r"\n\s*\n", text or "") if p.strip()]
    return "".join("<p>" + escape(p, quote=False).replace("\n", "<br/>") + "</p>" for p in parts)


FORMATS = {"md": markdown_html, "html": lambda s: s or "", "txt": plain_html}
BLOCK = T.StructType().add("pos", T.IntegerType()).add("tag", T.StringType()).add("text", T.StringType()).add("xhtml", T.StringType())
TAG = re.compile(r"<[^>]*>")


def blocks_of(source: str | None, fmt: str | None) -> list[dict]:
    """(pos, tag, text, xhtml) of a document of a format; of an HTML page what its body holds, or the fragment itself."""
    root = parse(FORMATS.get(fmt or "txt", plain_html)(source))
    body = root.find("body") or root
    from html import unescape

    return [{"pos": k, "tag": tag, "text": unescape(TAG.sub("", x)).strip(), "xhtml": x} for k, (tag, x) in enumerate(flow(body.children))]


@F.pandas_udf(T.ArrayType(BLOCK))
def blocks(source: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([blocks_of(s, f) for s, f in zip(source, fmt, strict=True)])


def rendered(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, text, xhtml) of documents (doc_id, format, text); a document without a block has no row."""
    return docs.select("doc_id", F.explode(blocks("text", "format")).alias("b")).select("doc_id", "b.*")


def titled(found: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, title, leads) of (doc_id, title, stem): the title given, else a leading h1, which is the first heading of any level, else the file's name; leads: whether an h1 leads."""
    heads = found.where("tag IN ('h1', 'h2', 'h3', 'h4')").groupBy("doc_id").agg(F.min_by(F.struct("tag", "text"), "pos").alias("h"))
    leads = F.coalesce(F.col("h.tag") == "h1", F.lit(False))
    return raw.join(heads, "doc_id", "left").select("doc_id", F.coalesce("title", F.when(leads, F.col("h.text")), F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"), leads.alias("leads"), "stem")


def with_heading(found: DataFrame, titles: DataFrame, subtitles: DataFrame) -> DataFrame:
    """The blocks with an h1 of the document's title before all others where none leads, and the subtitle (doc_id, subtitle) behind the h1 that leads."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda tag, body, x: (F.lit(tag).alias("tag"), body.alias("text"), x.alias("xhtml"))
    added = titles.where("NOT leads").select("doc_id", F.lit(-2.0).alias("at"), *row("h1", F.col("title"), F.concat(F.lit("<h1>"), text(F.col("title")), F.lit("</h1>"))))
    first = found.where("tag = 'h1'").groupBy("doc_id").agg(F.min("pos").alias("first"))
    place = F.when(F.col("leads"), F.col("first") + 0.5).otherwise(F.lit(-1.0))
    below = titles.join(subtitles.where("subtitle IS NOT NULL"), "doc_id").join(first, "doc_id", "left").select("doc_id", place.alias("at"), *row("p", F.col("subtitle"), F.concat(F.lit('<p class="subtitle">'), text(F.col("subtitle")), F.lit("</p>"))))
    whole = found.select("doc_id", F.col("pos").cast("double").alias("at"), "tag", "text", "xhtml").unionByName(added).unionByName(below)
    return whole.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("at")


def chapters(found: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, chapter, title, xhtml): a chapter from each h1 on; what stands before the first is one of its own under the document's title. Symbols are made safe."""
    numbered = found.withColumn("n", F.sum((F.col("tag") == "h1").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "xhtml"))), lambda r: r["xhtml"])
    made = numbered.groupBy("doc_id", "n").agg(F.max(F.when(F.col("tag") == "h1", F.col("text"))).alias("head"), F.array_join(rows, "\n").alias("xhtml"))
    named = made.join(titles.select("doc_id", F.col("title").alias("whole")), "doc_id")
    return named.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("chapter"), F.coalesce("head", "whole").alias("title"), safe_symbols(F.col("xhtml")).alias("xhtml"))


def converted(raw: DataFrame) -> DataFrame:
    """(doc_id, title, status, problems, epub) of (doc_id, format, text, title, stem, author, subtitle): the whole conversion.

    Markdown is normalised first. A document with a diagram that would not be drawn has status 3, its problems, and no package; all others have status 0.
    """
    from inkwell.operators.convert import blocks as source_blocks
    from inkwell.operators.convert import normalised
    from inkwell.operators.diagrams import problems
    from inkwell.plans.lineage import cut
    from inkwell.sources.sinks import epubs

    docs = normalised(raw.select("doc_id", "format", "text").where("format = 'md'")).unionByName(raw.select("doc_id", "format", "text").where("format <> 'md'"))
    # problems name the lines of the source as it came
    source = raw.where("format = 'md'").select("doc_id", "format", zero_width_fences(F.col("text")).alias("text"))
    fences = source_blocks(source).where("tag = 'pre'").select("doc_id", "line", "lang", "text")
    bad = problems(fences).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "problem"))), lambda x: F.concat(F.lit("line "), x["line"].cast("string"), F.lit(": "), x["problem"])).alias("problems"))
    found = cut(rendered(docs))  # the whole parse: titles, headings and chapters read it
    titles = titled(found, raw)
    whole = with_heading(found, titles, raw.select("doc_id", "subtitle"))
    parts = chapters(whole, titles)
    heads = titles.join(raw.select("doc_id", "author"), "doc_id").select("doc_id", versioned_title(F.col("title"), F.col("stem")).alias("title"), "author")
    books = epubs(heads.join(bad, "doc_id", "left_anti"), parts)
    return heads.join(bad, "doc_id", "left").join(books, "doc_id", "left").select("doc_id", "title", F.when(F.col("problems").isNull(), 0).otherwise(3).alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), "epub")


def anchored(text: Column) -> Column:
    """A heading's anchor: lower case, letters and digits with single dashes between."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
