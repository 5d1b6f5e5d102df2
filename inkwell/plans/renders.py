"""Queries of the sections that a digest shows, and of documents made of texts and images: parts are rows of the tables, and the SQL writes the same texts by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import bound
from inkwell.operators import diagrams, guards, sections
from inkwell.plans.registry import query, table
from inkwell.sources import readers

L = F.lit
P = "chr(10) || chr(10)"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _in_order(order: Column, value: Column) -> Column:
    """The values of a group in an order, null ones left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])


_SQL_DAY = "strftime(o_orderdate, '%A ') || day(o_orderdate) || strftime(o_orderdate, ' %B')"


@query(f"""
    WITH i AS (SELECT l_orderkey, count(*) AS n, list('Closed ' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'R') AS notices, count(*) FILTER (l_returnflag = 'A') AS dropped, list('https://www.rail.org/' || l_partkey || '/' ORDER BY l_linenumber, l_partkey, l_suppkey) AS urls FROM lineitem GROUP BY 1),
    o AS (SELECT orders.*, coalesce(notices, []) AS notices, dropped, urls, o_orderkey % 5 AS k FROM orders JOIN i ON l_orderkey = o_orderkey),
    t AS (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN '*Unavailable today: the Windrush line status. See the run check above.*' ELSE concat_ws({P}, CASE WHEN len(notices) > 0 THEN array_to_string(list_transform(notices, lambda x: '- ' || x), chr(10)) END,
        CASE WHEN dropped > 0 THEN '*Some TfL notices could not be shown; check the TfL status page.*' WHEN len(notices) = 0 THEN 'No planned disruption listed by TfL.' END) END AS line,
        CASE k WHEN 0 THEN '*Unavailable today: the Thameslink check. See the run check above.*' WHEN 1 THEN o_orderpriority || {P} || customer_text || {P} || '*From an AI web search; may be incomplete or wrong. Check before travelling.*' || {P} || 'Sources:' || {P} || array_to_string(list_transform(urls, lambda u: '- [' || replace(regexp_replace(u, '/$', ''), 'https://www.', '') || '](' || u || ')'), chr(10))
        ELSE '*An AI web search found no notice of planned Thameslink disruption for ' || {_SQL_DAY} || '. This is not a guarantee; check before travelling.*' END AS other FROM (SELECT *, o_custkey::VARCHAR AS customer_text FROM o))
    SELECT o_orderkey, concat_ws({P}, '## Trains', '### Windrush line (London Overground)', line, 'Source: [TfL line status](https://tfl.gov.uk/tube-dlr-overground/status/)', '### Thameslink', other, 'Check: [National Rail status and disruptions](https://www.nationalrail.co.uk/status-and-disruptions/)') AS section FROM t
""")
def trains_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section an order: returned items are notices, some could not be shown, and a search found something, nothing, or failed."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        _in_order(at, F.when(F.col("l_returnflag") == "R", F.concat(L("Closed "), _s("l_suppkey")))).alias("notices"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).cast("int").alias("dropped"),
        _in_order(at, F.concat(L("https://www.rail.org/"), _s("l_partkey"), L("/"))).alias("urls"),
    )
    both = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey") % 5
    status = F.when(F.col("o_custkey") % 7 != 0, F.struct("notices", "dropped"))
    search = F.when(k != 0, F.struct(F.when(k == 1, "disruption").otherwise("none").alias("status"), F.concat(F.col("o_orderpriority"), L("\n \n "), _s("o_custkey")).alias("summary"), F.col("urls")))
    return both.select("o_orderkey", sections.trains_section(F.to_date("o_orderdate"), status, search).alias("section"))


@query(f"""
    WITH e AS (SELECT user_id, ts::DATE AS date, string_agg(['light', 'moderate', 'heavy'][event_id % 3 + 1] || ' ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' likely' ELSE ' possible' END || ' in the ' || CASE WHEN event_id % 5 = 0 THEN 'morning and afternoon' ELSE 'evening' END, ' and ' ORDER BY ts, event_id) FILTER (event_id % 4 = 0) AS wet, sum(event_id) AS k FROM events GROUP BY ALL)
    SELECT user_id, date::VARCHAR AS date, '## Weather in Croydon' || {P} || CASE WHEN k % 5 = 0 THEN '*Unavailable today: the Croydon weather forecast. See the run check above.*' ELSE CASE WHEN k % 3 = 0 THEN 'Written ' || user_id ELSE 'Grey, then clear and cool, ' || coalesce('with ' || wet, 'and rain is unlikely') || '. A high of ' || day(date) || '°C.' END || {P} || 'Source: [Open-Meteo](https://open-meteo.com/)' END AS section FROM e
""")
def weather_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section a user and day: written, made of the day's spells where its writer brought nothing, or without a forecast."""
    i = F.col("event_id")
    intensity = F.element_at(F.array(L("light"), L("moderate"), L("heavy")), (i % 3 + 1).cast("int"))
    parts = F.when(i % 5 == 0, F.array(L("morning"), L("afternoon"))).otherwise(F.array(L("evening")))
    spell = F.struct(intensity.alias("intensity"), F.col("event_type").alias("kind"), (i % 2 == 0).alias("likely"), parts.alias("parts"))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(_in_order(F.struct("ts", "event_id"), F.when(i % 4 == 0, spell)).alias("spells"), F.sum("event_id").alias("k"))
    day = F.when(F.col("k") % 5 != 0, F.struct(L("grey, THEN clear").alias("sky"), L("cool").alias("feel"), F.concat(_s(F.dayofmonth("date")), L("°C")).alias("high"), F.col("spells")))
    text = F.when(F.col("k") % 3 == 0, F.concat(L("Written "), _s("user_id"))).otherwise(F.when(F.col("k") % 2 == 0, " "))
    return days.select("user_id", _s("date").alias("date"), sections.weather_section(day, text).alias("section"))


@query(f"""
    WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) FILTER (turn % 2 = 1) AS why, list('https://www.a.org/' || role || '/' || turn || '/' ORDER BY turn) AS urls FROM conversations GROUP BY 1)
    SELECT conv_id, md5(CASE WHEN conv_id % 4 = 0 THEN '## AI Engineering' || {P} || '*Theme: T' || conv_id || '*' || {P} || '*Unavailable today: the AI Engineering topic. See the run check above.*' ELSE concat_ws({P}, '## AI Engineering: Talk ' || conv_id, '*Theme: T' || conv_id || '*', '### Concept',
        array_to_string(list_filter(list_transform(regexp_split_to_array(array_to_string(texts, chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> ''), {P}), '### Why it matters',
        CASE WHEN len(why) > 0 THEN array_to_string(list_transform(why, lambda x: '- ' || x), chr(10)) END, '### Sources', array_to_string(list_transform(urls, lambda u: '- [' || replace(regexp_replace(u, '/$', ''), 'https://www.', '') || '](' || u || ')'), chr(10))) END) AS digest FROM c
""")
def lesson_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lesson a conversation, whose turns are its concept, reasons and sources; every fourth failed."""
    turn, i = F.col("turn"), F.col("conv_id")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        _in_order(turn, F.col("text")).alias("texts"),
        _in_order(turn, F.when(turn % 2 == 1, F.col("role"))).alias("why"),
        _in_order(turn, F.concat(L("https://www.a.org/"), "role", L("/"), _s("turn"), L("/"))).alias("urls"),
    )
    lesson = F.when(i % 4 != 0, F.struct(F.concat(L("Talk "), _s(i)).alias("title"), F.array_join("texts", "\n \n").alias("concept"), F.col("why"), F.col("urls")))
    return talks.select("conv_id", F.md5(sections.engineering_section(F.concat(L("T"), _s(i)), lesson)).alias("digest"))


@query(f"""
    WITH v AS (SELECT l_orderkey, string_agg('**' || l_linenumber || '** ' || mark || '  ' || chr(10) || l_partkey, {P} ORDER BY l_linenumber, l_partkey, l_suppkey) AS verses, list(l_linenumber || CASE WHEN l_suppkey % 5 = 0 THEN '–' || (l_linenumber + 1) ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'A') AS gone, any_value(l_orderkey % 3 = 0) AS headed FROM (SELECT *, l_linestatus AS mark FROM lineitem) GROUP BY 1),
    g AS (SELECT *, len(gone) > 1 OR contains(gone[1], '–') AS many, CASE WHEN len(gone) = 1 THEN gone[1] ELSE array_to_string(gone[:len(gone) - 1], ', ') || ' and ' || gone[len(gone)] END AS listed FROM v)
    SELECT l_orderkey, concat_ws({P}, '### Book ' || l_orderkey, CASE WHEN headed THEN '*On ' || l_orderkey || '*' END, verses, '*' || CASE WHEN many THEN 'Verses ' ELSE 'Verse ' END || listed || CASE WHEN many THEN ' are' ELSE ' is' END || ' left out of this translation: the best manuscripts do not have ' || CASE WHEN many THEN 'them' ELSE 'it' END || '.*') AS chapter FROM g
""")
def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter an order, a verse an item; items that came back are verses left out, some of them ranges."""
    at, n = F.struct("l_linenumber", "l_partkey", "l_suppkey"), F.col("l_linenumber")
    verse = F.struct(_s(n).alias("v"), F.array(F.col("l_linestatus"), _s("l_partkey")).alias("lines"))
    gone = F.concat(_s(n), F.when(F.col("l_suppkey") % 5 == 0, F.concat(L("-"), _s(n + 1))).otherwise(""))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_in_order(at, verse).alias("verses"), _in_order(at, F.when(F.col("l_returnflag") == "A", gone)).alias("gone"))
    heading = F.when(F.col("l_orderkey") % 3 == 0, F.concat(L("On "), _s("l_orderkey"))).otherwise(" ")
    return orders.select("l_orderkey", sections.chapter_text(L("Book"), F.col("l_orderkey"), heading, F.col("verses"), F.col("gone")).alias("chapter"))


@query("""
    WITH s AS (SELECT c_nationkey, c_mktsegment AS label, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY first) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM s),
    m AS (SELECT c_nationkey, '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || string_agg('    s' || i || '["' || first || ' to ' || last || ': ' || label || '"]', chr(10) ORDER BY i) || coalesce(chr(10) || string_agg('    s' || i || ' --> s' || (i + 1), chr(10) ORDER BY i) FILTER (i < n - 1), '') || chr(10) || '```' AS outline FROM o GROUP BY 1),
    a AS (SELECT c.c_nationkey, s.label, min((c.last, s.first, s.last)) AS place FROM s c JOIN s ON c.c_nationkey = s.c_nationkey AND c.last BETWEEN s.first AND s.last WHERE c.last % 2 = 0 GROUP BY ALL),
    b AS (SELECT c_nationkey, string_agg(label, '; ' ORDER BY place) AS labels FROM a GROUP BY 1)
    SELECT c_nationkey, outline, coalesce(labels, '') AS labels FROM m LEFT JOIN b USING (c_nationkey)
""")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline a nation, a part a segment of its customers, and the parts that the last customers of segments, of even numbers, fall in."""
    parts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    listed = parts.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("first", "last", F.col("c_mktsegment").alias("label")))).alias("parts"))
    chapters = F.array_sort(F.filter(F.transform("parts", lambda p: p["last"]), lambda c: c % 2 == 0))
    drawn = sections.outline(F.col("parts"), lambda a, b: F.concat(_s(a), L(" to "), _s(b)))
    return listed.select("c_nationkey", drawn.alias("outline"), sections.outline_label(F.col("parts"), chapters).alias("labels"))


_DRAWN = ("", "-->", "| + |", "a -> b", "└─ ", "  |  ", "+---+", "text")


@query(r"""
    WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    m AS (SELECT doc_id, i // 3 AS part, CASE WHEN (i + doc_id) % 8 IN (2, 5) THEN '' ELSE line END AS raw, ['', '-->', '| + |', 'a -> b', '└─ ', '  |  ', '+---+', 'text'][(i + doc_id) % 8 + 1] AS px FROM e),
    l AS (SELECT doc_id, part, px || raw AS line FROM m),
    c AS (SELECT doc_id, part, regexp_matches(line, '[\x{2500}-\x{25FF}\x{2190}-\x{21FF}]') AS glyph, regexp_matches(line, '[\x{2500}-\x{25FF}]') AS box, regexp_matches(line, '-->|<--|->|<-|==>|=>|\+-{2,}|-{2,}\+') AS joins, regexp_full_match(line, '[\s|│┃v^↓↑▼▲+\-─=]+') AND trim(line) <> '' AS strokes, line FROM l)
    SELECT doc_id, part::INTEGER AS part, bool_or(glyph) OR count(*) FILTER (joins OR strokes) >= 2 AS is_text, count(*) FILTER (trim(line) <> '' AND (box OR joins OR strokes AND regexp_matches(line, '[|│┃v^↓↑▼▲+\-─=]'))) >= 2 AS is_flow FROM c GROUP BY ALL
""")
def drawn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each three lines of all documents, marked with arrows, boxes and strokes: whether they are a diagram in text, and one that flows."""
    k = lambda i: (i + F.col("doc_id")) % len(_DRAWN)
    put = F.array(*map(L, _DRAWN))
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.element_at(put, (k(i) + 1).cast("int")), F.when(k(i).isin(2, 5), "").otherwise(x)))
    threes = lambda l: F.transform(F.sequence(L(0), F.floor((F.size(l) - 1) / 3).cast("int")), lambda n: F.array_join(F.slice(l, n * 3 + 1, L(3)), "\n"))
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(bound(marked, threes)).alias("part", "t"))
    return parts.select("doc_id", "part", diagrams.is_text_diagram(F.col("t")).alias("is_text"), diagrams.is_flow_diagram(F.col("t")).alias("is_flow"))


@query(r"""
    WITH t AS (SELECT doc_id, replace(replace(replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text || ' <&>' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents),
    p AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x) <> '') AS p FROM t)
    SELECT doc_id, len(p)::INTEGER AS paragraphs, md5(array_to_string(list_transform(p, lambda x: '<p>' || replace(trim(x, chr(10)), chr(10), '<br/>') || '</p>'), '')) AS digest FROM p
""")
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all documents read as plain texts, half of them with blank lines put in."""
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 2 == 0, F.replace("text", L("\n"), L("\n \n"))).otherwise(F.concat("text", L(" <&>")))
    found = readers.text_paragraphs(source)
    return docs.select("doc_id", F.size(found).alias("paragraphs"), F.md5(F.array_join(found, "")).alias("digest"))


@query(r"""
    WITH p AS (SELECT page_id, url, html, 'a "b" <' || page_id || '>_pic.png' AS name, page_id % 3 AS k, (page_id % 40 + 1) * 100 AS w, (page_id % 30 + 1) * 100 AS h FROM pages)
    SELECT page_id, '<p><img src="/in/a &quot;b&quot; &lt;' || page_id || '&gt;_pic.png" alt="a &quot;b&quot; &lt;' || page_id || '&gt; pic"/></p>' AS image, k = 0 AS is_png, CASE WHEN k = 1 THEN 'flag: not a PNG' END AS diagnostic, CASE WHEN k <> 1 THEN url END AS value,
           least(1.0, 1072.0 / w, 1448.0 / h)::DOUBLE AS scale, md5('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || CASE WHEN k = 2 THEN 'T &amp; ' || page_id ELSE replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || '</title></head>' || chr(10) || '<body>' || chr(10) || html || chr(10) || '</body></html>') AS saved FROM p
""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as files of their own: an image of each, whether its bytes are a PNG, what a failure leaves, its scale on the device, and the page as it is saved."""
    i, k = F.col("page_id"), F.col("page_id") % 3
    path = F.concat(L('/in/a "b" <'), _s(i), L(">_pic.png"))
    body = F.when(k == 0, F.unhex(L("89504E470D0A1A0A00"))).when(k == 1, F.unhex(L("89504E"))).otherwise(F.encode("html", "UTF-8"))
    step = guards.or_unavailable(F.col("url"), F.when(k == 1, "flag: not a PNG"))
    scale = diagrams.fit_scale(((i % 40 + 1) * 100).cast("double"), ((i % 30 + 1) * 100).cast("double"))
    saved = readers.fetched_document(F.when(k == 2, F.concat(L("T & "), _s(i))), F.col("url"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", readers.image_document(path).alias("image"), readers.is_png(body).alias("is_png"), step["diagnostic"].alias("diagnostic"), step["value"].alias("value"), scale.alias("scale"), F.md5(saved).alias("saved"))


@query(f"""
    WITH c AS (SELECT c_custkey AS i, c_mktsegment AS label, c_acctbal AS hv, c_custkey * 1.5 AS ov, c_custkey % 7 = 0 AS lacking, c_custkey % 5 = 0 AS searched, c_custkey % 13 = 0 AS wide FROM customer),
    d AS (SELECT *, round(printf('%.1f', ov)::DOUBLE * 10)::BIGINT - round(printf('%.1f', hv)::DOUBLE * 10)::BIGINT AS d, printf('%.1f%%', hv) || ' (1995)' AS home, CASE WHEN lacking THEN 'not available today' ELSE printf('%.1f%%', ov) || ' (1996)' END AS other,
        CASE WHEN lacking THEN NULL WHEN i % 11 = 0 THEN 'counted by hand' WHEN wide THEN 'a figure comes from a different source, so definitions may differ' END AS reason FROM c),
    r AS (SELECT *, CASE WHEN NOT lacking AND reason IS NULL AND hv <> 0 THEN CASE WHEN d = 0 THEN 'the same as the UK''s' ELSE printf('%.1f', abs(d) / 10.0) || ' percentage points ' || CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END || ' than the UK''s' END END AS relation FROM d)
    SELECT i AS c_custkey, '## UK vs Jamaica' || {P} || CASE WHEN i % 17 = 0 THEN '*Unavailable today: the UK vs Jamaica fact. See the run check above.*' ELSE concat_ws({P}, '### ' || label,
        '| | UK | Jamaica |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || label || ' | ' || home || ' | ' || other || ' |', '*Not compared: ' || reason || '.*', CASE WHEN i % 6 = 0 AND NOT lacking THEN '**What the figures count:** Jamaica: all.' END,
        CASE WHEN i % 3 = 0 THEN 'Text.' ELSE 'A share. The UK''s figure is ' || home || ' and Jamaica''s is ' || other || '.' || coalesce(' Jamaica''s figure is ' || relation || '.', '') END,
        CASE WHEN searched AND NOT lacking THEN '> **Note:** Jamaica''s figure was found by an AI (LLM) ' || CASE WHEN i % 4 = 0 THEN 'web search of ' ELSE 'web search fallback of ' END || 's.org' || CASE WHEN wide THEN ' (a wider search of official statistics sites)' ELSE '' END || CASE WHEN i % 4 = 0 THEN '; no data API covers this fact.' ELSE ', not from a data API.' END END,
        'Sources: ' || CASE WHEN lacking THEN '[Bank — X (UK)](https://b.org)' WHEN searched THEN '[Bank — X (UK)](https://b.org) · [Office (Jamaica)](https://www.s.org/p)' ELSE '[Bank — X](https://b.org)' END) END AS section FROM r
""")
def comparison_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section a customer: their balance and a number of their own as two countries' shares, some searched, some lacking, some not to be compared."""
    i = F.col("c_custkey")
    entry = F.struct(F.col("c_mktsegment").alias("label"), L("A share.").alias("meaning"), L("pct").alias("format"), L(None).cast("string").alias("unit"), L("Bank").alias("org"), L("X").alias("code"), F.when(i % 4 == 0, "search").otherwise("worldbank").alias("source"), (i % 11 != 0).alias("harmonised"), L("counted by hand").alias("not_compared_because"))

    def figure(value: Column, year: int, searched: Column, note: Column, tier: Column) -> Column:
        pick = lambda a, b: F.when(searched, a).otherwise(b)
        return F.struct(value.alias("value"), L(year).alias("year"), pick("search", "api").alias("via"), L(False).alias("estimate"), note.alias("unit_note"), pick("https://www.s.org/p", "https://b.org").alias("url"), pick("Office", "Bank").alias("org"), tier.alias("tier"))

    home = F.when(i % 17 != 0, figure(F.col("c_acctbal"), 1995, L(False), L(None).cast("string"), L(None).cast("int")))
    other = F.when((i % 17 != 0) & (i % 7 != 0), figure(i * 1.5, 1996, i % 5 == 0, F.when(i % 6 == 0, "all."), F.when(i % 13 == 0, 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", sections.comparison_section(entry, home, other, F.when(i % 3 == 0, "Text.").otherwise(" ")).alias("section"))


_SQL_WEEK = "strftime({0}, '%A ') || day({0}) || strftime({0}, ' %B')"


@query(f"""
    WITH c AS (SELECT c_custkey AS i, c_mktsegment AS book, c_name AS title, DATE '2026-01-04' + (c_custkey % 300)::INTEGER AS day, DATE '2026-01-04' + (c_custkey % 300)::INTEGER + 7 AS next FROM customer)
    SELECT i AS c_custkey, concat_ws({P}, '## Sunday Reading: ' || title, '*World (public)*',
        CASE WHEN i % 4 = 0 THEN concat_ws({P}, CASE WHEN i % 8 = 0 THEN '*Unavailable today: the overview of ' || book || '. See the run check above.*' ELSE '### Who wrote it' || {P} || 'One' || {P} || 'two' || {P} || '### What it''s about' || {P} || 'About ' || book END,
            '### Structure', 'Outline', '*Outline compiled from Wikipedia.*', '### Reading plan', '- week 1' || chr(10) || '- week 2', CASE WHEN i % 12 = 0 THEN '### The Prologue' || {P} || 'In the beginning' END) END,
        '### Look back', CASE WHEN i % 5 = 0 THEN 'This is the first Sunday reading.' ELSE 'Previous reading (' || {_SQL_WEEK.format("day")} || '): ' || CASE WHEN i % 2 = 0 THEN 'an overview of ' ELSE '' END || title || '.' || CASE WHEN i % 2 = 1 AND i % 3 <> 0 THEN {P} || 'Then ' || i ELSE '' END END,
        CASE i % 3 WHEN 1 THEN 'Chapter ' || i WHEN 2 THEN 'Chapter ' || i || {P} || 'Chapter ' || (i + 1) END,
        '### Look forward', 'Next reading (' || {_SQL_WEEK.format("next")} || '): ' || CASE WHEN i % 2 = 1 THEN 'an overview of ' || book ELSE book || ' (part of: P' || i || ')' END || '.',
        CASE WHEN i % 2 = 0 THEN 'Source: [World — eBible.org](https://e)' ELSE 'Sources: [World — eBible.org](https://e) · [' || book || ' — Wikipedia](https://w/' || i || ')' END) AS section FROM c
""")
def reading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Sunday reading a customer: first and later weeks of a book, first Sundays, readings of none to two chapters."""
    i, book, title = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    day = F.date_add(L("2026-01-04").cast("date"), (i % 300).cast("int"))
    overview = F.when(i % 4 == 0, F.struct(L("One\n\n two ").alias("authorship"), F.when(i % 8 != 0, F.concat(L("About "), book)).alias("about"), L("Outline").alias("outline"), F.array(L("week 1"), L("week 2")).alias("plan"), F.when(i % 12 == 0, "In the beginning").otherwise("").alias("prologue")))
    previous = F.when(i % 5 != 0, F.struct(title.alias("title"), day.alias("date"), (i % 2 == 0).alias("overview")))
    upcoming = F.struct(book.alias("title"), F.date_add(day, 7).alias("date"), (i % 2 == 1).alias("overview"), F.concat(L("P"), _s(i)).alias("part"))
    chapters = F.slice(F.array(F.concat(L("Chapter "), _s(i)), F.concat(L("Chapter "), _s(i + 1))), L(1), (i % 3).cast("int"))
    wiki = F.when(i % 2 == 1, F.struct(book.alias("title"), F.concat(L("https://w/"), _s(i)).alias("url")))
    recap = F.when(i % 3 != 0, F.concat(L("Then "), _s(i))).otherwise(" ")
    reading = F.struct(title.alias("title"), L("World").alias("translation"), L("Public").alias("licence"), L("https://e").alias("url"), overview.alias("overview"), book.alias("book"), previous.alias("previous"), recap.alias("recap"), chapters.alias("chapters"), upcoming.alias("next"), wiki.alias("wiki"))
    return table(spark, sf_dir, "customer").select("c_custkey", sections.reading_section(reading).alias("section"))
