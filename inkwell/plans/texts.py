"""Queries over documents and pages: emoji images, link audits, lines after normalising; widths of columns and medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import alignment, links, measures
from inkwell.plans.marked import SQL_LINES, marked
from inkwell.plans.registry import query, table

#: What goes before the lines of a document, by number: sequences of one character and several, and one that is preformatted.
EMOJI = ("😀", "", "👍🏽 ", "🇬🇧", "", "👩‍💻", "<pre>😀 ☂️</pre>", "❤️ ", "🎉🎉", "")
_IMAGE = "'<img class=\"emoji-img\" src=\"images/emoji-' || sha256({0})[:16] || '.png\" alt=\"' || {0} || '\"/>'"
_PUT = [f"'{e}'" if not e or e.startswith("<pre") else f"{_IMAGE.format(chr(39) + e.strip() + chr(39))} || '{' ' if e.endswith(' ') else ''}'" if e != "🎉🎉" else " || ".join([_IMAGE.format("'🎉'")] * 2) for e in EMOJI]
_SQL_EMOJI = f"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM s),
"""


def _with_emoji(docs: DataFrame) -> DataFrame:
    put = F.array(*map(F.lit, EMOJI))

    def one(line: Column, i: Column) -> Column:
        return F.concat(F.element_at(put, (F.pmod(i + F.col("doc_id"), F.lit(len(EMOJI))) + 1).cast("int")), line)

    return docs.select("doc_id", F.array_join(F.transform(text.lines(F.col("text")), one), "\n").alias("text"))


@query(_SQL_EMOJI + f"p AS (SELECT doc_id, i, [{', '.join(_PUT)}][((i + doc_id) % {len(EMOJI)}) + 1] || line AS line FROM e) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p GROUP BY doc_id")
def emoji_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an image for each emoji but those that are preformatted."""
    return _with_emoji(table(spark, sf_dir, "documents")).select("doc_id", F.md5(text.with_emoji_images(F.col("text"))).alias("digest"))


_SEQUENCES = ", ".join("[" + ", ".join(f"'{c}'" for c in (["🎉", "🎉"] if e == "🎉🎉" else [e.strip()] if e and not e.startswith("<pre") else [])) + "]" for e in EMOJI)


@query(_SQL_EMOJI + f"""
    p AS (SELECT doc_id, i, [{_SEQUENCES}][((i + doc_id) % {len(EMOJI)}) + 1] AS found FROM e),
    u AS (SELECT doc_id, i, unnest(found) AS sequence FROM p),
    g AS (SELECT sequence, min((doc_id, i)) AS first, count(DISTINCT doc_id) AS documents, count(*) AS places FROM u GROUP BY sequence)
    SELECT row_number() OVER (ORDER BY first)::INTEGER AS number, 'images/emoji-' || sha256(sequence)[:16] || '.png' AS asset, sequence, documents, places FROM g
""")
def emoji_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that all documents need, each once."""
    return text.emoji_assets(_with_emoji(table(spark, sf_dir, "documents")), "doc_id", "text").withColumn("places", F.col("places").cast("long"))


_SQL_LINKS = "(SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '\\s(?:href|src)=\"([^\"]*)\"', 1)) AS link FROM pages)"


@query(f"""
    WITH l AS (SELECT page_id, replace(replace(replace(replace(link, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS link, count(*) AS times FROM {_SQL_LINKS} GROUP BY ALL),
    a AS (SELECT page_id, link FROM l WHERE length(link) % 3 <> 0)
    SELECT * FROM l ANTI JOIN a USING (page_id, link)
""")
def page_links_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that are not on their page's list; the list has those whose length is no multiple of three."""
    found = links.links(table(spark, sf_dir, "pages"), links.html_links(F.col("html")), "page_id")
    return links.foreign(found, found.where(F.length("link") % 3 != 0), "page_id")


@query(r"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM s),
    m AS (SELECT doc_id, ['https://e.org/' || (i % 7), NULL, 'img/' || (i % 5) || '_(a).png', 'https://host.example/p?q=' || (doc_id % 9)][(i % 4) + 1] AS own, line FROM e),
    b AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(regexp_replace(line, '\]\([^)]*\)', ']', 'g'), '(?i)\b(?:https?|ftp)://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))) AS link FROM m),
    f AS (SELECT doc_id, own AS link FROM m WHERE own IS NOT NULL UNION ALL FROM b), l AS (SELECT doc_id, link, count(*) AS times FROM f GROUP BY ALL)
    SELECT * FROM l WHERE NOT starts_with(link, 'https://e.org/') OR doc_id % 2 = 1 AND link <> 'https://e.org/1'
""")
def text_links_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents, marked with some by line, that are not on their document's list: one site for every other document, one address of it for the rest."""
    line = lambda x, i: F.concat(F.element_at(F.array(F.concat(F.lit("[see](https://e.org/"), (i % 7).cast("string"), F.lit(") ")), F.lit(""), F.concat(F.lit("![a b](img/"), (i % 5).cast("string"), F.lit('_(a).png "t") ')), F.concat(F.lit("at https://host.example/p?q="), (F.col("doc_id") % 9).cast("string"), F.lit(", "))), (i % 4 + 1).cast("int")), x)
    marks = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(text.lines(F.col("text")), line), "\n").alias("text"))
    found = links.links(marks, links.markdown_links(F.col("text")), "doc_id")
    own = F.when(F.col("doc_id") % 2 == 0, F.sequence(F.lit(0), F.lit(6))).otherwise(F.array(F.lit(1)))
    allowed = marks.select("doc_id", F.explode(own).alias("n")).select("doc_id", F.concat(F.lit("https://e.org/"), F.col("n").cast("string")).alias("link"))
    return links.foreign(found, allowed, "doc_id")


_HASHTAG, _BLOCK = r"NOT mask AND regexp_matches(line, '^#+[^#\s]')", r"^\s*([-*+]|\d+\.)\s+|^\s*\|"


@query(SQL_LINES + f"""
    , n AS (SELECT doc_id, i, line, {_HASHTAG} AS anew, coalesce(NOT mask AND regexp_matches(line, '{_BLOCK}') AND i > 0 AND trim(before) <> '' AND NOT regexp_matches(before, '{_BLOCK}'), false) AS more FROM w)
    SELECT doc_id, i + 1 + sum(more::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS line, CASE WHEN NOT anew THEN i + 1 END AS source_line FROM n QUALIFY regexp_matches(line, '\\S')
""".replace("FROM n QUALIFY regexp_matches(line", "FROM n QUALIFY regexp_matches(n.line"))
def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents after normalising that are not blank, with the lines of the source that they were."""
    docs = marked(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("source"), text.blank_before_blocks(text.hashtags(F.col("text"))).alias("result"))
    shown = docs.select(F.col("doc_id").alias("of"), F.posexplode(text.lines(F.col("result"))).alias("at", "written")).where(r"written RLIKE '\\S'")
    found = alignment.source_lines(docs, "doc_id", "source", "result")
    kept = found.join(shown, (F.col("doc_id") == F.col("of")) & (F.col("line") == F.col("at") + 1), "left_semi")
    return kept.select("doc_id", F.col("line").cast("long").alias("line"), F.col("source_line").cast("long").alias("source_line"))


@query("""
    WITH c AS (SELECT p_brand AS brand, p_size % 6 AS place, p_name || ' ' || repeat('x', (p_partkey % 23)::INTEGER) AS t FROM part),
    s AS (SELECT brand, place, greatest(max(length(t)), 1)::DOUBLE AS weight, max(list_max(list_transform(string_split(t, ' '), lambda x: length(x)))) * 4.5 + 12 AS least FROM c GROUP BY ALL),
    k AS (SELECT a.brand, a.place, (468 - coalesce(sum(b.least) FILTER (b.least / b.weight > a.least / a.weight), 0)) / sum(b.weight) FILTER (b.least / b.weight <= a.least / a.weight) AS level FROM s AS a JOIN s AS b USING (brand) GROUP BY ALL),
    m AS (SELECT brand, min(level) AS level FROM k GROUP BY brand), f AS (SELECT brand, sum(least) AS least FROM s GROUP BY brand)
    SELECT s.brand, s.place, round(CASE WHEN f.least >= 468 THEN s.least * 468 / f.least ELSE greatest(s.least, m.level * s.weight) END, 6) AS width FROM s JOIN m USING (brand) JOIN f USING (brand)
""")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column widths of a table a brand, a row a part, on a page 468 points wide."""
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 6).alias("place"), F.concat_ws(" ", "p_name", F.expr("repeat('x', cast(p_partkey % 23 as int))")).alias("t"))
    found = measures.widths(measures.cell_sizes(cells, ["brand"], "place", "t", 4.5), ["brand"], 468.0)
    return found.select("brand", "place", F.round("width", 6).alias("width"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 6) AS price FROM lineitem GROUP BY ALL")
def price_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of groups that each hold a large share of all rows."""
    found = measures.medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return found.select("l_returnflag", "l_linestatus", "n", F.round("median", 6).alias("price"))


@query("SELECT o_custkey, count(*) AS n, round(median(o_totalprice), 6) AS price FROM orders GROUP BY ALL")
def customer_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of many small groups."""
    found = measures.medians(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return found.select("o_custkey", "n", F.round("median", 6).alias("price"))
