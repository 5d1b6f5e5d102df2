"""Sinks: texts, state, EPUB packages; and the sizing and sending rules."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSS = "\n".join(
    (
        "body{font-family:serif;line-height:1.4}",
        "h1,h2,h3,h4{font-family:sans-serif;line-height:1.2;page-break-after:avoid}",
        "h1{page-break-before:always}",
        "pre,code{font-family:monospace}",
        "pre{white-space:pre-wrap;border:1px solid #999;padding:.5em}",
        "table{border-collapse:collapse;width:100%}",
        "th,td{border:1px solid #999;padding:.2em .4em;vertical-align:top}",
        "blockquote{margin:1em;padding-left:.6em;border-left:3px solid #999}",
        "img.content-img{max-width:100%}",
        ".subtitle{font-style:italic}",
        ".qa-label{font-weight:bold}",
        ".img-fallback{color:#555}",
    )
)


def write_texts(df: DataFrame, path: str, folders: int = 256) -> None:
    """Texts by their slug: JSON lines (slug, text) in at most ``folders`` folders by the slug's hash, so that many texts do not make as many folders."""
    df.select("slug", "text", F.pmod(F.xxhash64("slug"), F.lit(folders)).alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def read_text(spark, path: str, slug: str, folders: int = 256) -> str | None:
    """The text of a slug, from its folder alone."""
    rows = spark.read.schema("slug string, text string, part long").json(path)
    found = rows.where((F.col("part") == F.pmod(F.xxhash64(F.lit(slug)), F.lit(folders))) & (F.col("slug") == slug)).first()
    return found and found.text


def write_state(state: DataFrame, path: str) -> None:
    """Replaces a state table. The new one is written to a folder of its own under ``path``; then a pointer to it is put down under the next number, which nobody
    has put one under before. A crash at any moment leaves the version before in force; of writers at once the last counts, and none's rows mix with another's.
    Writers that must see each other's changes use commits.update(). Versions before the last two are removed."""
    import uuid

    from inkwell.sources.commits import _Store
    from inkwell.sources.readers import state_versions

    spark, folder = state.sparkSession, f"version-{uuid.uuid4().hex}"
    store = _Store(spark, path)
    state.write.parquet(f"{path}/{folder}")
    number = max(state_versions(spark, path), default=0) + 1
    while not store.put(f"_current-{number}", folder):
        number += 1
    for old in state_versions(spark, path):
        if old < number - 1:
            gone = store.text(f"_current-{old}")
            store.remove(f"_current-{old}")
            store.remove(gone)


def epub(title: str, author: str, chapters: list[tuple[str, str]], images: list[tuple[str, str, bytes]] = ()) -> bytes:
    """An EPUB of ordered chapters (title, XHTML) and images (path, media type, content), with an NCX and a nav document."""
    from html import escape

    names = [f"chap_{k:02d}.xhtml" for k in range(1, len(chapters) + 1)]
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(head)}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'
    nav = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, (t, _)) in enumerate(zip(names, chapters, strict=True), 1))
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names, 1)) + "".join(f'<item id="i{k}" href="{p}" media-type="{m}"/>' for k, (p, m, _) in enumerate(images, 1))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(names) + 1))
    package = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", package)
        z.writestr("OEBPS/style.css", CSS)
        z.writestr("OEBPS/nav.xhtml", page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>'))
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        for n, (t, body) in zip(names, chapters, strict=True):
            z.writestr(f"OEBPS/{n}", page(t, body))
        for p, _, content in images:
            z.writestr(f"OEBPS/{p}", content)
    return out.getvalue()


def epubs(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, epub): a package per document of (doc_id, title, author) and (doc_id, chapter, title, xhtml)."""
    parts = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "xhtml"))).alias("parts"))

    @F.pandas_udf(T.BinaryType())
    def build(title: pd.Series, author: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([epub(t or "", a or "", [(p["title"], p["xhtml"]) for p in ps]) for t, a, ps in zip(title, author, parts, strict=True)])

    return documents.join(parts, "doc_id").select("doc_id", build("title", "author", "parts").alias("epub"))


def should_send(flag: Column, fmt: Column) -> Column:
    return (fmt == "epub") & F.coalesce(flag, F.lit(True))


def error_text(kind: Column, code: Column) -> Column:
    """The class and number of an error, never its message."""
    return F.concat_ws(" ", kind, code.cast("string"))


def math_height(px: Column, reference: Column, display: Column) -> Column:
    """The height of a rendered expression in em: against a line's own height, 1 at least, 1.3 at most within a line and 6 on a line of its own."""
    return F.least(F.greatest(F.lit(1.0), F.round(px / reference, 2)), F.when(display, F.lit(6.0)).otherwise(F.lit(1.3)))


def image_scale(width: Column, height: Column, column: Column) -> Column:
    """The largest scale, 1 at most, at which an image fits the column and 7.3 inches at 96 dots an inch."""
    return F.least(F.lit(1.0), column / width, F.lit(7.3 * 96) / height)


def column_widths(longest: list[float], tokens: list[float], total: float) -> list[float]:
    """Widths in proportion to the longest cells, none below its longest token and 12; what that takes comes off the others; all shrink where even that is too much."""
    floors = [t + 12 for t in tokens]
    if not longest or sum(floors) >= total:
        scale = total / sum(floors) if floors else 0
        return [f * scale for f in floors]
    fixed: dict[int, float] = {}
    while True:
        free = [k for k in range(len(longest)) if k not in fixed]
        rest, mass = total - sum(fixed.values()), sum(longest[k] for k in free)
        share = {k: rest * longest[k] / mass if mass else rest / len(free) for k in free}
        low = [k for k in free if share[k] < floors[k]]
        if not low:
            return [fixed.get(k, share.get(k, 0.0)) for k in range(len(longest))]
        fixed |= {k: floors[k] for k in low}
