"""Sources: files by extension, feeds, and the shapes of landed API pages. Fetching is done elsewhere; pages are landed as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.measures import medians
from inkwell.operators.ranges import box_overlaps

TEXTS, IMAGES = ("md", "markdown", "html", "htm", "txt"), ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg")
# Media types of images.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}
MAX_BYTES = 20 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, stem, text, content): whole files by their extension; an unknown one is an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    kind = F.when(ext.isin("md", "markdown"), "md").when(ext.isin("html", "htm"), "html").when(ext == "txt", "txt").when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image")
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))).cast("string"))
    return raw.select("path", kind.alias("format"), stem(F.col("path")).alias("stem"), F.when(ext.isin(*TEXTS), F.decode("content", "UTF-8")).alias("text"), "content")


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.try_element_at(table, extension(path))


def fetched(pages: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """Landed fetches (url, status, content) with ``error``: an HTTP status, a body over the cap, or none. Rows are never dropped."""
    bad = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.col("content").isNull(), "no body").when(F.octet_length("content") > cap, "too large")
    return pages.withColumn("error", bad).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def best_attempts(attempts: DataFrame, by: list[str], what: Column) -> DataFrame:
    """(by, content, error) of landed attempts (by, attempt, content, kind, code): the first that succeeded, else the class and number of the last error, never its message."""
    order = F.struct(F.col("content").isNull(), F.when(F.col("content").isNull(), -F.col("attempt")).otherwise(F.col("attempt")))
    best = attempts.groupBy(*by).agg(F.min_by(F.struct("content", "kind", "code"), order).alias("a"))
    failed = F.concat(what, F.lit(": "), F.concat_ws(" ", F.col("a.kind"), F.col("a.code").cast("string")))
    return best.select(*by, F.col("a.content").alias("content"), F.when(F.col("a.content").isNull(), failed).alias("error"))


# What stands for an image that cannot be shown; the head and the end of a fetched page's file; bytes that image files begin with.
NO_IMAGE = "[Image could not be loaded: "
PAGE_HEAD, PAGE_BODY, PAGE_END = '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>', "</title></head>\n<body>\n", "\n</body></html>"
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "474946383961", "image/gif ": "474946383761", "image/bmp": "424D"}


def image_of(url: Column, status: Column, content_type: Column, content: Column, alt: Column, failure: Column, cap: int = MAX_BYTES) -> Column:
    """struct(media_type, reason, placeholder) of a fetched image: what it is by its bytes, or why it cannot be shown and the text in its place.

    ``failure`` is timeout, connection error or fetch error where nothing came; a body that is named an image and is none is corrupt.
    """
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    vector = (kind == "image/svg+xml") | (F.lower(F.substring_index(url, "?", 1)).endswith(".svg") & kind.isin("text/xml", "application/xml", "image/svg+xml"))
    begins = lambda hexed: F.hex(F.substring(content, 1, len(hexed) // 2)) == hexed
    raster = F.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp")
    for name, hexed in MAGIC.items():
        raster = raster.when(begins(hexed), name.strip())
    drawn = F.contains(F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1")), F.lit("<svg"))
    reason = F.when(failure.isNotNull(), failure).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when((kind != "") & ~kind.startswith("image/") & ~vector, "not an image").when(F.octet_length(content) > cap, "too large").when(vector & ~drawn, "not an image").when(~vector & raster.isNull(), "corrupt image data")
    shown = F.when(reason.isNull(), F.when(vector, "image/svg+xml").otherwise(raster))
    place = F.when(reason.isNotNull(), F.concat(F.lit(NO_IMAGE), F.left(F.coalesce(F.nullif(F.trim(alt), F.lit("")), url), F.lit(60)), F.lit("]")))
    return F.struct(shown.alias("media_type"), reason.alias("reason"), place.alias("placeholder"))


def image_document(path: Column) -> Column:
    """An image file as a document of its own: a paragraph with the image, its name as the text in its place."""
    quoted = lambda x: F.replace(escaped_text(x), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<p><img src="'), quoted(path), F.lit('" alt="'), quoted(F.replace(stem(path), F.lit("_"), F.lit(" "))), F.lit('"/></p>'))


def escaped_text(x: Column) -> Column:
    from inkwell.functions.text import escaped

    return escaped(x)


# Extensions of pasted inputs by their format.
PASTED = {"md": ".md", "html": ".html", "txt": ".txt"}


def pasted_name(title: Column, fmt: Column, at: Column) -> Column:
    """The file name of a pasted input: its title's slug, else ``pasted``, and the time."""
    from inkwell.functions.text import page_slug

    ending = F.create_map(*[F.lit(x) for pair in PASTED.items() for x in pair])[fmt]
    return F.concat(F.coalesce(page_slug(title, None), F.lit("pasted")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), ending)


def fetched_name(title: Column, url: Column, date: Column, at: Column) -> Column:
    """The file name of a fetched page: ``url_``, the slug of its title, else of its URL, its own date where it has one, and the time."""
    from inkwell.functions.text import page_slug

    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.concat(F.lit("url_"), F.coalesce(page_slug(title, None), page_slug(bare)), F.lit("_"), F.coalesce(F.concat(date, F.lit("_")), F.lit("")), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".html"))


def fetched_document(title: Column, url: Column, article: Column) -> Column:
    """A fetched article as an HTML file of its own."""
    named = escaped_text(F.coalesce(title, url))
    return F.concat(F.lit(PAGE_HEAD), named, F.lit(PAGE_BODY), article, F.lit(PAGE_END))


def elements_html(kind: Column, level: Column, text: Column, rows: Column) -> Column:
    """An element of a paginated document as HTML: a heading, h4 at the lowest, a paragraph, or a table of rows of cells; a null cell is empty."""
    tag = F.concat(F.lit("h"), F.least(level, F.lit(4)).cast("string"))
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped_text(F.coalesce(c, F.lit(""))), F.lit("</td>"))), "")
    table = F.when(F.size(rows) > 0, F.concat(F.lit("<table><tbody>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(r), F.lit("</tr>"))), ""), F.lit("</tbody></table>"))).otherwise("")
    heading = F.concat(F.lit("<"), tag, F.lit(">"), escaped_text(text), F.lit("</"), tag, F.lit(">"))
    return F.when(kind == "heading", heading).when(kind == "para", F.concat(F.lit("<p>"), F.replace(escaped_text(text), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))).otherwise(table)


def summaries(pages: DataFrame) -> DataFrame:
    """(key, title, extract, url, error) of landed encyclopedia summaries (key, json): one that only tells terms apart, or has no text, is an error."""
    x = F.from_json("json", "type string, title string, titles struct<normalized:string>, extract string, content_urls struct<desktop:struct<page:string>>")
    found = pages.select("key", x.alias("s")).withColumn("extract", F.regexp_replace("s.extract", r"(?U)^\s+|\s+$", ""))
    error = F.when(F.col("s").isNull() | (F.coalesce("s.type", F.lit("")) == "disambiguation") | (F.coalesce("extract", F.lit("")) == ""), "no usable extract")
    good = lambda c: F.when(error.isNull(), c)
    return found.select("key", good(F.coalesce("s.titles.normalized", "s.title")).alias("title"), good(F.col("extract")).alias("extract"), good(F.col("s.content_urls.desktop.page")).alias("url"), error.alias("error"))


def leads(found: DataFrame, pages: DataFrame, cap: int = 600) -> DataFrame:
    """summaries() with the extract widened to a landed lead section (key, lead), ``cap`` words at most; ``note`` says where the summary's own paragraph had to do."""
    from inkwell.functions.text import first_words

    both = found.join(pages.select("key", F.nullif(F.trim("lead"), F.lit("")).alias("lead")), "key", "left")
    usable = F.col("error").isNull() & F.col("lead").isNotNull()
    return both.select("key", "title", F.when(usable, first_words(F.col("lead"), cap)).otherwise(F.col("extract")).alias("extract"), "url", "error", F.when(F.col("error").isNull() & F.col("lead").isNull(), "full lead unavailable; used the summary paragraph only").alias("note"))


def is_png(content: Column) -> Column:
    return F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))


def text_paragraphs(text: Column) -> Column:
    """Paragraphs of a plain text: cut at empty lines, escaped, line feeds as breaks."""
    from inkwell.functions.text import escaped

    parts = F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.concat(F.lit("<p>"), F.replace(escaped(F.btrim(x, F.lit("\n"))), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """(feed_pos, guid, title, link, pub_date, content_html, image_url, channel, author) of RSS files, one channel a file."""
    image = T.StructType([T.StructField("_href", T.StringType())])
    item = T.StructType([T.StructField(n, T.StringType()) for n in ("guid", "title", "link", "pubDate", "description", "encoded")] + [T.StructField("image", image)])
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("image", image), T.StructField("item", T.ArrayType(item))])
    channels = spark.read.format("xml").option("rowTag", "channel").option("ignoreNamespace", "true").schema(schema).load(path)
    rows = channels.select(F.posexplode("item").alias("feed_pos", "i"), "title", "author", "image")
    stamp = F.regexp_replace(F.regexp_replace("i.pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC?|Z)\s*$", " +0000")
    when = F.to_timestamp(stamp, "d MMM yyyy HH:mm:ss Z")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    body = F.coalesce(F.nullif(F.col("i.encoded"), F.lit("")), F.col("i.description"), F.lit(""))
    cover = F.coalesce(F.nullif(text(F.col("i.image._href")), F.lit("")), text(F.col("image._href")))
    return rows.select("feed_pos", text(F.col("i.guid")).alias("guid"), text(F.col("i.title")).alias("title"), text(F.col("i.link")).alias("link"), when.alias("pub_date"), body.alias("content_html"), cover.alias("image_url"), F.col("title").alias("channel"), "author").where("guid <> ''")


def world_bank(pages: DataFrame, entities: list[str]) -> DataFrame:
    """(indicator, entity, year, value) of landed ``[meta, rows]`` pages (json): nulls dropped, numeric strings taken, non-finite values an error's business: dropped."""
    row = "struct<indicator:struct<id:string>,countryiso3code:string,date:string,value:string>"
    rows = F.from_json(F.get_json_object("json", "$[1]"), f"array<{row}>")
    x = pages.select(F.explode(rows).alias("r")).select("r.*")
    value = x["value"].try_cast("double")
    return x.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & x["countryiso3code"].isin(*entities)).select(F.col("indicator.id").alias("indicator"), F.col("countryiso3code").alias("entity"), F.col("date").cast("int").alias("year"), value.alias("value"))


def imf(pages: DataFrame, last_year: int) -> DataFrame:
    """(indicator, entity, year, value) of landed ``{values: {code: {entity: {year: value}}}}`` pages, without projections."""
    nested = F.from_json(F.get_json_object("json", "$.values"), "map<string,map<string,map<string,double>>>")
    a = pages.select(F.explode(nested).alias("indicator", "m")).select("indicator", F.explode("m").alias("entity", "y")).select("indicator", "entity", F.explode("y").alias("year", "value"))
    return a.select("indicator", "entity", F.col("year").cast("int").alias("year"), "value").where((F.col("year") <= last_year) & F.col("value").isNotNull())


def who(pages: DataFrame, last_year: int, entities: list[str] | None = None, pinned: dict[str, str] | None = None) -> DataFrame:
    """(entity, year, value) of landed ``{value: [...]}`` pages, of the given entities and pinned dimensions (sex, age group) alone; a second row for an entity
    and year means that the dimensions do not say which, and is an error."""
    from inkwell.operators.series import unambiguous

    pinned = pinned or {}
    fields = "".join(f",{d}:string" for d in pinned)
    rows = F.from_json(F.get_json_object("json", "$.value"), f"array<struct<SpatialDim:string,TimeDim:int,NumericValue:double{fields}>>")
    x = pages.select(F.explode(rows).alias("r")).select("r.*")
    for d, value in pinned.items():
        x = x.where(F.col(d) == value)
    if entities is not None:
        x = x.where(F.col("SpatialDim").isin(*entities))
    x = x.select(F.col("SpatialDim").alias("entity"), F.col("TimeDim").alias("year"), F.col("NumericValue").alias("value"), F.lit(1).alias("one"))
    return unambiguous(x.where((F.col("year") <= last_year) & F.col("value").isNotNull()), ["one"]).drop("one")


def hourly(pages: DataFrame) -> DataFrame:
    """(t, chance, mm, code): landed forecasts of parallel arrays under one fixed offset; arrays of unequal length are an error."""
    schema = "utc_offset_seconds int, hourly struct<time:array<string>,precipitation_probability:array<double>,precipitation:array<double>,weather_code:array<int>>"
    x = pages.select(F.from_json("json", schema).alias("j")).select("j.utc_offset_seconds", "j.hourly.*")
    same = (F.size("time") == F.size("precipitation_probability")) & (F.size("time") == F.size("precipitation")) & (F.size("time") == F.size("weather_code"))
    sure = F.when(same, F.arrays_zip("time", "precipitation_probability", "precipitation", "weather_code")).otherwise(F.raise_error(F.lit("arrays of unequal length")).cast("array<struct<time:string,precipitation_probability:double,precipitation:double,weather_code:int>>"))
    rows = x.select("utc_offset_seconds", F.explode(sure).alias("h"))
    moment = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm")) - F.col("utc_offset_seconds"))
    return rows.select(moment.alias("t"), F.col("h.precipitation_probability").alias("chance"), F.col("h.precipitation").alias("mm"), F.col("h.weather_code").alias("code"))


def catalogue(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of a JSON catalogue's array ``field``; anything that does not fit the schema is an error."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(f"`{field}` array<struct<{schema}>>").json(path).select(F.explode(field).alias("r")).select("r.*")


def break_faults(breaks: DataFrame) -> DataFrame:
    """Entries of a calendar (name, start, end) that cannot be: no name, no date, or an end before the start."""
    return breaks.where((F.coalesce(F.trim("name"), F.lit("")) == "") | F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end")))


def rota_faults(rota: DataFrame) -> DataFrame:
    """Rows of a stewards' rota (date, team, note) that cannot be: a date given twice, both or neither of team and note, or a text that is empty, of several lines or marked up."""
    from pyspark.sql.window import Window

    plain = lambda c: F.col(c).isNull() | ((F.trim(c) != "") & ~F.col(c).rlike(r"(?i)[\r\n\[\]<>*_`|\\$#]|https?:|www\."))
    counted = rota.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("date")))
    wrong = F.array_compact(F.array(F.when(F.col("times") > 1, "duplicate"), F.when(F.col("team").isNull() == F.col("note").isNull(), "one of team and note"), F.when(~(plain("team") & plain("note")), "text")))
    return counted.select("date", "team", "note", wrong.alias("faults")).where(F.size("faults") > 0)


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a state table whose pointer is there, that is which were written whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("_current-")) for n in names if n.startswith("_current-"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table's last whole version, or an empty table where there is none yet."""
    from inkwell.sources.commits import _Store

    versions = state_versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{_Store(spark, path).text(f'_current-{versions[-1]}')}") if versions else spark.createDataFrame([], schema)


# Spans of a paginated document: headings by size, tables by overlap


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """(doc_id, block, text, size, bold, level) of (doc_id, block, pos, text, size, bold) spans: median size, majority of bold, heading level against the document's median."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    blocks = spans.groupBy("doc_id", "block").agg(joined.alias("text"), F.median("size").alias("size"), (F.avg(F.col("bold").cast("int")) > 0.5).alias("bold"))
    body = medians(spans, ["doc_id"], "size").select("doc_id", F.col("median").alias("body"))  # of all spans of a document, however many
    ratio = F.col("size") / F.col("body")
    level = F.when(F.col("body") <= 0, F.lit(None).cast("int")).when(ratio >= 1.5, 1).when(ratio >= 1.25, 2).when((ratio >= 1.1) | (F.col("bold") & (ratio >= 1.0)), 3)
    return blocks.join(body, "doc_id").select("doc_id", "block", "text", "size", "bold", level.alias("level"))


def table_of_block(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, block, table): the first table of the same page that covers over half of a block. Both have doc_id, page and x0, y0, x1, y1."""
    found = box_overlaps(blocks, tables, ["doc_id", "page"])
    return found.groupBy(F.col("left.doc_id").alias("doc_id"), F.col("left.block").alias("block")).agg(F.min("right.table").alias("table"))


def page_elements(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, y, kind, level, text, rows) of a paginated document in reading order: by page, then from top to bottom.

    blocks: (doc_id, page, block, text, level, x0, y0, x1, y1); tables: (doc_id, page, table, rows, x0, y0, x1, y1). A block that a table covers over half of is that
    table's text and is left out; the table stands where it begins.
    """
    inside = table_of_block(blocks, tables).select("doc_id", "block")
    none = F.lit(None).cast("array<array<string>>")
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("para")
    texts = blocks.join(inside, ["doc_id", "block"], "left_anti").select("doc_id", "page", F.col("y0").alias("y"), kind.alias("kind"), "level", "text", none.alias("rows"))
    grids = tables.select("doc_id", "page", F.col("y0").alias("y"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), "rows")
    return texts.unionByName(grids)


def pages_html(elements: DataFrame) -> DataFrame:
    """(doc_id, html): a document's elements, in reading order, as HTML."""
    piece = F.struct("page", "y", elements_html(F.col("kind"), F.col("level"), F.col("text"), F.col("rows")).alias("html"))
    return elements.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["html"]), "").alias("html"))
