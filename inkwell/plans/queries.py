"""The registered queries of the engine's own operators, each over its whole tables, with the SQL that must give the same rows.

The tables hold few of the structures that the text rules look for, so ``marked`` puts them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import folds, latex, text, urls
from inkwell.operators import convert, diagrams, digest, feed, guards, hours, html, rotation, series, transcripts, xhtml
from inkwell.plans import digests, landed, ranges, renders, rules, streams, texts  # noqa: F401: they register their queries
from inkwell.plans.marked import SQL_LINES, marked, sql_lines
from inkwell.plans.registry import _ORACLES, _QUERIES, Query, query, table


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


_ITEM, _BLOCK, _LABEL = r"^(\s*)(\d{1,9})\\?\)(\s+)(\S.*)$", r"^\s*([-*+]|\d+\.)\s+|^\s*\|", r"^\*\*[^*\n]+:\*\*(\s|$)"


def _by_line_sql(expression: str) -> str:
    return SQL_LINES + f"SELECT doc_id, md5(string_agg({expression}, chr(10) ORDER BY i)) AS digest FROM w GROUP BY doc_id"


def _normaliser(rule) -> Query:
    return lambda spark, sf_dir: marked(table(spark, sf_dir, "documents")).select("doc_id", F.md5(rule(F.col("text"))).alias("digest"))


for _name, _rule, _expression in (
    ("normalize_hashtags", text.hashtags, r"CASE WHEN NOT mask AND regexp_matches(line, '^#+[^#\s]') THEN '\' || line ELSE line END"),
    ("normalize_paren_lists", text.paren_lists, f"CASE WHEN NOT mask AND regexp_matches(line, '{_ITEM}') AND (i = 0 OR (NOT before_mask AND (trim(before) = '' OR regexp_matches(before, '{_ITEM}'))) OR (after IS NOT NULL AND NOT after_mask AND regexp_matches(after, '{_ITEM}'))) THEN regexp_replace(line, '{_ITEM}', '\\1\\2.\\3\\4') ELSE line END"),
    ("metadata_breaks", text.metadata_breaks, f"CASE WHEN NOT mask AND regexp_matches(line, '{_LABEL}') AND after IS NOT NULL AND NOT after_mask AND regexp_matches(after, '{_LABEL}') AND NOT ends_with(line, '  ') THEN line || '  ' ELSE line END"),
    ("blank_before_blocks", text.blank_before_blocks, f"CASE WHEN NOT mask AND regexp_matches(line, '{_BLOCK}') AND i > 0 AND trim(before) <> '' AND NOT regexp_matches(before, '{_BLOCK}') THEN chr(10) || line ELSE line END"),
    ("export_timestamps", text.export_timestamps, "CASE WHEN NOT mask AND line = '**Created:** 8/31/2026 9:44:08' THEN '**Created:** 2026-08-31 09:44:08' ELSE line END"),
    ("symbols_safe", text.safe_symbols, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '✅([\p{L}\p{N}])', '[Yes] \1', 'g'), '✅', '[Yes]', 'g'), '⚠️?([\p{L}\p{N}])', '[Warning] \1', 'g'), '⚠️?', '[Warning]', 'g')"),
):
    _QUERIES[_name], _ORACLES[_name] = _normaliser(_rule), _by_line_sql(_expression)


@query(SQL_LINES + "SELECT doc_id, i AS pos, line, mask AS in_fence FROM w")
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(table(spark, sf_dir, "documents")).withColumn("rows", text.lines(F.col("text")))
    both = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("rows").alias("line"), text.fence_mask(F.col("rows")).alias("mask"))).alias("pos", "x"))
    return both.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.line").alias("line"), F.col("x.mask").alias("in_fence"))


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM s")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""
    SELECT doc_id, nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[:60], '') AS slug,
           md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS alnum, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped,
           len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS words
    FROM documents
""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no length limit comes as a digest."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.page_slug(x, None).alias("slug"), F.md5(text.alnum(x)).alias("alnum"), F.md5(text.escaped(x)).alias("escaped"), text.n_words(x).alias("words"))


# pages


@query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h, regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, url, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host,
           trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title, NULL::VARCHAR AS author, NULL::VARCHAR AS published,
           md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS body
    FROM p
""")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.articles(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", urls.host(F.col("url")).alias("host"), "title", "author", F.col("date").alias("published"), F.md5("text").alias("body"))


@query()
def page_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every page's article as XHTML."""
    found = html.articles(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.lit("html").alias("format"), F.col("html").alias("text"))
    return xhtml.rendered(found)


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.articles(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.explode(html.blocks("html")).alias("b")).select("page_id", "b.*")


_SQL_URLS = "(SELECT page_id, 'HTTPS://WWW.' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || CASE page_id % 4 WHEN 0 THEN '?utm_source=x' WHEN 1 THEN '#top' WHEN 2 THEN '?id=' || page_id || '&gclid=1#a' ELSE '' END AS u FROM pages)"


def _raw_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("page_id") % 4 == 0, "?utm_source=x").when(F.col("page_id") % 4 == 1, "#top").when(F.col("page_id") % 4 == 2, F.concat(F.lit("?id="), F.col("page_id").cast("string"), F.lit("&gclid=1#a"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("HTTPS://WWW."), F.regexp_replace("url", r"^https?://|[?#].*$", ""), tail).alias("u"))


@query(f"SELECT page_id, lower(regexp_extract(u, '^[^:]+://[^/?#]*')) || regexp_replace(regexp_replace(regexp_replace(u, '#.*$', ''), '^[^:]+://[^/?#]*', ''), '([?&])(utm_source|gclid)=[^&]*', '') AS key FROM {_SQL_URLS}")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_urls(spark, sf_dir).select("page_id", urls.normalised(F.col("u")).alias("key"))


@query(f"""
    WITH l AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS s FROM {_SQL_URLS})
    SELECT page_id, CASE WHEN length(s) <= 70 THEN s ELSE left(s, 67) || '...' END AS label FROM l
""")
def url_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_urls(spark, sf_dir).select("page_id", urls.label(F.col("u")).alias("label"))


@query(f"""
    WITH k AS (SELECT page_id, regexp_extract(lower(u), '^[^:]+://([^/?#:]*)', 1) AS h FROM {_SQL_URLS}),
    d AS (SELECT * FROM (VALUES ('example.com', 'Example'), ('com', 'Commerce'), ('ample.com', 'Wrong')) AS t(domain, publisher))
    SELECT page_id, coalesce((SELECT max_by(publisher, length(domain)) FROM d WHERE h = domain OR ends_with(h, '.' || domain)), regexp_replace(h, '^www\\.', '')) AS publisher FROM k
""")
def domain_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame([("example.com", "Example"), ("com", "Commerce"), ("ample.com", "Wrong")], "domain string, publisher string")
    return urls.publishers(_raw_urls(spark, sf_dir), domains, "u").select("page_id", "publisher")


@query("""
    WITH h AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host FROM pages)
    SELECT host, min(page_id) AS page_id, count(*) AS pages FROM h GROUP BY host
""")
def url_host_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host")).groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


# conversations as question and answer transcripts

_SQL_TALK = "(SELECT conv_id, turn * 2 AS pos, CASE role WHEN 'user' THEN 'Question:' WHEN 'assistant' THEN 'response' ELSE 'System' END AS text, 'p' AS tag FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, text, CASE WHEN turn % 5 = 4 THEN 'h1' ELSE 'p' END FROM conversations)"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", "Question:").when(F.col("role") == "assistant", "response").otherwise("System")
    heads = turns.select("conv_id", (F.col("turn") * 2).alias("pos"), head.alias("text"), F.lit("p").alias("tag"))
    return heads.unionByName(turns.select("conv_id", (F.col("turn") * 2 + 1).alias("pos"), "text", F.when(F.col("turn") % 5 == 4, "h1").otherwise("p").alias("tag")))


@query(f"""
    WITH b AS (SELECT *, CASE WHEN tag = 'p' AND text = 'Question:' THEN 'question' WHEN tag = 'p' AND text = 'response' THEN 'answer' END AS kind FROM {_SQL_TALK}),
    r AS (SELECT *, sum((kind = 'question')::INT) OVER o AS round, sum((kind IS NOT NULL OR tag = 'h1')::INT) OVER o AS g FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
    t AS (SELECT conv_id, g, min_by(coalesce(kind, ''), pos) AS kind, min_by(coalesce(round, 0), pos) AS round, count(*) - 1 AS members FROM r GROUP BY conv_id, g)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g)::INTEGER AS turn, kind, round::BIGINT AS round,
           upper(kind[1]) || kind[2:] || CASE WHEN round > 0 THEN ' ' || round::BIGINT ELSE '' END AS label, members FROM t WHERE kind <> ''
""")
def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.turns(_talk(spark, sf_dir), "conv_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def qa_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda r: F.count(F.when(F.col("role") == r, 1))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(role("user").alias("questions"), role("assistant").alias("answers"))


@query(f"""
    WITH b AS (SELECT *, sum((tag = 'h1')::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM {_SQL_TALK})
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n)::INTEGER AS chapter, coalesce(max(CASE WHEN tag = 'h1' THEN text END), 'Opening') AS title, count(*) AS blocks FROM b GROUP BY conv_id, n
""")
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chapters(_talk(spark, sf_dir), "Opening", "conv_id")


# rotation and calendar over a date dimension; the items are nations and regions

_SQL_RAW = """
    WITH i AS (SELECT 'country' AS category, n_nationkey AS item FROM nation UNION ALL SELECT 'area', r_regionkey FROM region),
    z AS (SELECT *, count(*) OVER (PARTITION BY category) AS n FROM i),
    c AS (SELECT unnest(range(0, 80)) AS cycle),
    raw AS (SELECT category, cycle, item, n, least(3, n // 3) AS gap, row_number() OVER (PARTITION BY category, cycle ORDER BY sha256(category || ':' || cycle || ':' || item), item) - 1 AS raw FROM z, c),
    j AS (SELECT a.*, a.raw < 2 * a.gap AND b.item IS NOT NULL AS late FROM raw a LEFT JOIN raw b ON a.category = b.category AND a.item = b.item AND b.cycle = a.cycle - 1 AND b.raw >= b.n - b.gap),
    o AS (SELECT category, cycle, item, n, row_number() OVER (PARTITION BY category, cycle ORDER BY raw >= 2 * gap, late, raw) - 1 AS pos FROM j)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.lit("country").alias("category"), F.col("n_nationkey").alias("item"))
    return nations.unionByName(table(spark, sf_dir, "region").select(F.lit("area").alias("category"), F.col("r_regionkey").alias("item")))


@query(_SQL_RAW + """
    , d AS (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-12-31', INTERVAL 1 DAY))::DATE AS date),
    k AS (SELECT DISTINCT category, n FROM o)
    SELECT d.date, o.category, o.item FROM d, k JOIN o ON o.category = k.category AND o.cycle = (d.date - DATE '2026-01-01') // k.n AND o.pos = (d.date - DATE '2026-01-01') % k.n
""", dates=('date',))
def rotation_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.picks(rotation.dates(spark, "2026-01-01", "2026-12-31"), _items(spark, sf_dir))


@query(_SQL_RAW + "SELECT category, cycle, item, pos FROM o WHERE cycle < 40")
def rotation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    cycles = items.select("category").distinct().withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    return rotation.cycle_orders(items, cycles).withColumn("pos", F.col("pos").cast("long"))


_SQL_BREAKS = """
    WITH d AS (SELECT unnest(generate_series(min(o_orderdate) + INTERVAL 31 YEAR, max(o_orderdate) + INTERVAL 31 YEAR, INTERVAL 1 DAY))::DATE AS date FROM orders),
    b AS (SELECT * FROM (VALUES (1, 'Winter', DATE '2026-12-24', DATE '2027-01-02'), (2, 'Pause', DATE '2026-12-30', DATE '2027-01-05'), (3, 'Summer', DATE '2027-08-01', DATE '2027-08-14')) AS t(priority, name, s, e)),
    easter AS (SELECT * FROM (VALUES (DATE '2026-04-05'), (DATE '2027-03-28'), (DATE '2028-04-16'), (DATE '2029-04-01'), (DATE '2030-04-21'), (DATE '2031-04-13'), (DATE '2032-03-28'), (DATE '2033-04-17')) AS t(sunday)),
    h AS (SELECT * FROM (VALUES (DATE '2026-05-04', 'May Day'), (DATE '2027-03-29', 'Monday')) AS t(date, name)),
    x AS (SELECT d.date, (SELECT min_by(name, priority) FROM b WHERE d.date BETWEEN s AND e) AS listed, EXISTS (SELECT 1 FROM easter WHERE d.date - sunday BETWEEN -2 AND 1) AS is_easter FROM d),
    named AS (SELECT x.date, coalesce(listed, CASE WHEN is_easter THEN 'Easter' END, h.name) AS name FROM x LEFT JOIN h ON h.date = x.date)
"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first order to the last, 31 years later."""
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(F.explode(F.sequence(*(F.add_months(F.to_date(c), 12 * 31) for c in ("a", "b")))).alias("date"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = spark.sql("SELECT * FROM VALUES (1, 'Winter', DATE'2026-12-24', DATE'2027-01-02'), (2, 'Pause', DATE'2026-12-30', DATE'2027-01-05'), (3, 'Summer', DATE'2027-08-01', DATE'2027-08-14') AS t(priority, name, start, end)")
    holidays = spark.sql("SELECT * FROM VALUES (DATE'2026-05-04', 'May Day'), (DATE'2027-03-29', 'Monday') AS t(date, name)")
    return rotation.break_names(_days(spark, sf_dir), breaks, holidays)


@query(_SQL_BREAKS + "SELECT date, name FROM named", dates=('date',))
def break_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir)


@query(_SQL_BREAKS + "SELECT a.date, a.name, (SELECT min(date) FROM named n WHERE n.date > a.date AND n.name IS NULL) AS back FROM named a WHERE a.name IS NOT NULL", dates=('date', 'back'))
def next_open_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.breaks_with_return(_named(spark, sf_dir))


@query(_SQL_BREAKS + """
    , plan AS (SELECT * FROM (VALUES (0, 'Sirach', NULL, NULL), (1, 'Sirach', 1, 2), (2, 'Sirach', 3, 4), (3, 'Sirach', 5, 5), (4, 'Wisdom', NULL, NULL), (5, 'Wisdom', 1, 2)) AS t(week, book, first, last)),
    s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS a FROM named WHERE dayofweek(date) = 0 AND date >= DATE '2026-02-01' AND name IS NULL)
    SELECT date, a::INTEGER AS absolute, week::INTEGER AS week, book, first::INTEGER AS first, last::INTEGER AS last, lag(date) OVER (ORDER BY date) AS previous_date, lead(date) OVER (ORDER BY date) AS next_date FROM s JOIN plan ON week = a % 6
""", dates=('date', 'previous_date', 'next_date'))
def reading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = spark.sql("SELECT * FROM VALUES (1, 'Sirach', 5), (2, 'Wisdom', 2) AS t(seq, book, chapters)")
    found = rotation.readings(_named(spark, sf_dir), rotation.reading_plan(books), "2026-02-01")
    return found.select("date", "absolute", F.col("week").cast("int").alias("week"), "book", "first", "last", "previous_date", "next_date")


# series: yearly order totals; each nation against a home nation (key 0), by segment: a series of two entities per other nation

_SQL_HOME = """
    t AS (SELECT c_mktsegment AS segment, n_nationkey AS k, n_name AS entity, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    p AS (SELECT segment, entity AS other, entity, year, value FROM t WHERE k <> 0 UNION ALL SELECT segment, n_name, entity, year, value FROM t, nation WHERE k = 0 AND n_nationkey <> 0)
"""


def _against_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    found = sold.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    others = F.broadcast(nations.where("n_nationkey <> 0").select(F.col("n_name").alias("other")))
    home = found.where("k = 0").crossJoin(others).drop("k")
    return found.where("k <> 0").withColumn("other", F.col("entity")).drop("k").unionByName(home)


@query(f"WITH {_SQL_HOME}, s AS (SELECT segment, other, year FROM p GROUP BY ALL HAVING count(DISTINCT entity) = 2) SELECT segment, other, max(year) AS common FROM s GROUP BY ALL")
def latest_common_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_common_year(_against_home(spark, sf_dir), ["segment", "other"], 2)


@query(f"""
    WITH {_SQL_HOME}, s AS (SELECT * FROM p WHERE year BETWEEN 1992 AND 1998),
    c AS (SELECT segment, other, max(year) AS common FROM (SELECT segment, other, year FROM s GROUP BY ALL HAVING count(DISTINCT entity) = 2) GROUP BY ALL),
    o AS (SELECT segment, other, entity, max(year) AS own FROM s GROUP BY ALL)
    SELECT o.segment, o.other, o.entity, coalesce(common, own) AS year, round(s.value, 2) AS value FROM o LEFT JOIN c USING (segment, other) JOIN s ON s.segment = o.segment AND s.other = o.other AND s.entity = o.entity AND s.year = coalesce(common, own)
""")
def country_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.observations(_against_home(spark, sf_dir), ["segment", "other"], 2, 1998).withColumn("value", F.round("value", 2))


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN rtrim(rtrim(printf('%.2f', o_totalprice / 1e6), '0'), '.') || ' million' ELSE format('{:,.0f}', o_totalprice) END AS plain,
           printf('%.1f%%', o_totalprice / 1e4) AS pct, printf('%.3f', o_totalprice / 1e5) AS idx FROM orders
""")
def value_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", series.format_value(x, F.lit("plain")).alias("plain"), series.format_value(x / 1e4, F.lit("pct")).alias("pct"), series.format_value(x / 1e5, F.lit("index")).alias("idx"))


# hours: events by the hour as forecasts

_SQL_HOURS = "(SELECT user_id % 10 AS place, date_trunc('hour', ts) + INTERVAL 1 HOUR AS t, (max(event_id) % 101)::DOUBLE AS chance, (count(*) % 7) / 4.0 AS mm, (sum(event_id) % 100)::INTEGER AS code FROM events GROUP BY ALL)"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy((F.col("user_id") % 10).alias("place"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("t"))
    return by.agg((F.max("event_id") % 101).cast("double").alias("chance"), ((F.count(F.lit(1)) % 7) / 4.0).alias("mm"), (F.sum("event_id") % 100).cast("int").alias("code"))


@query(f"""
    WITH w AS (SELECT *, t - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY place ORDER BY t) AS island FROM {_SQL_HOURS} WHERE chance >= 50 OR mm >= 0.1),
    g AS (SELECT place, min(t) - INTERVAL 1 HOUR AS start, max(t) AS "end", list(code) AS codes, max(mm) AS mm, bool_or(chance >= 70 OR (mm >= 0.1 AND chance >= 50)) AS likely, max(chance)::INTEGER AS peak_chance FROM w GROUP BY place, island)
    SELECT place, start, "end", CASE WHEN len(list_filter(codes, lambda c: c BETWEEN 95 AND 99)) > 0 THEN 'thunderstorms' WHEN list_has_any(codes, [71, 73, 75, 77, 85, 86]) THEN 'snow' WHEN list_has_any(codes, [80, 81, 82]) THEN 'showers'
           WHEN len(list_filter(codes, lambda c: c BETWEEN 61 AND 67)) > 0 THEN 'rain' WHEN len(list_filter(codes, lambda c: c BETWEEN 51 AND 57)) > 0 THEN 'drizzle' ELSE 'rain' END AS kind,
           CASE WHEN mm > 4 THEN 'heavy' WHEN mm >= 0.5 THEN 'moderate' ELSE 'light' END AS intensity, likely, peak_chance FROM g
""")
def wet_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours.wet_spells(_hours(spark, sf_dir), ["place"]).drop("parts")


@query(f"""
    WITH d AS (SELECT place, (t - INTERVAL 1 HOUR)::DATE AS date, code FROM {_SQL_HOURS} WHERE hour(t - INTERVAL 1 HOUR) BETWEEN 7 AND 18),
    s AS (SELECT place, date, avg((code IN (0, 1))::INT) AS clear, avg((code = 3 OR code >= 45)::INT) AS cloudy FROM d GROUP BY ALL)
    SELECT place, date, CASE WHEN clear >= 0.6 THEN 'mostly sunny' WHEN cloudy >= 0.9 THEN 'grey' WHEN cloudy >= 0.6 THEN 'mostly cloudy' ELSE 'sunny spells' END AS sky FROM s
""", dates=('date',))
def day_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours.sky(_hours(spark, sf_dir).withColumn("date", F.to_date(F.expr("t - interval 1 hour"))), ["place", "date"])


@query(f"""
    WITH h AS (SELECT place, t, count(*) AS n FROM {_SQL_HOURS} GROUP BY ALL), d AS (SELECT DISTINCT ts::DATE AS date FROM events),
    w AS (SELECT place, date, date + INTERVAL 1 HOUR * k AS t FROM d, (SELECT DISTINCT place FROM h), unnest(range(1, 25)) AS u(k))
    SELECT place, date, count(*) AS expected, sum(coalesce(n, 0))::BIGINT AS found, bool_and(coalesce(n, 0) = 1) AS complete FROM w LEFT JOIN h USING (place, t) GROUP BY ALL
""", dates=('date',))
def hour_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    return hours.coverage(_hours(spark, sf_dir), days, ["place"])


@query("""
    WITH d AS (SELECT DISTINCT (o_orderdate + INTERVAL 25 YEAR)::DATE AS date FROM orders)
    SELECT date, timezone('UTC', timezone('Europe/London', date::TIMESTAMP)) AS start, timezone('UTC', timezone('Europe/London', (date + INTERVAL 1 DAY)::TIMESTAMP)) AS stop FROM d
""", dates=('date',))
def civil_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.add_months(F.to_date("o_orderdate"), 300).alias("date")).distinct()
    return days.select("date", hours.day_start(F.col("date")).alias("start"), hours.day_end(F.col("date")).alias("stop"))


@query("""
    SELECT l_orderkey, l_linenumber, o_orderdate < DATE '1996-06-16' + INTERVAL 1 DAY - INTERVAL 1 HOUR AND l_shipdate > DATE '1996-06-16' - INTERVAL 1 HOUR AS hit FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def overlap_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    moment = lambda c: F.col(c).cast("timestamp")
    return both.select("l_orderkey", "l_linenumber", hours.overlaps(moment("o_orderdate"), moment("l_shipdate"), F.lit("1996-06-16").cast("date")).alias("hit"))


# events as feed items; odd users have been delivered


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    items = events.select(F.col("event_id").cast("string").alias("guid"), F.col("ts").cast("timestamp").alias("pub_date"), F.col("event_id").alias("feed_pos"))
    return items, events.where("user_id % 2 = 1").select(F.col("event_id").cast("string").alias("guid"), F.lit("sent").alias("how"), F.col("ts").cast("timestamp").alias("at"))


@query("SELECT event_id::VARCHAR AS guid, ts AS pub_date FROM events WHERE user_id % 2 = 0")
def feed_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.unseen(*_feed(spark, sf_dir)).select("guid", "pub_date")


@query("SELECT 4::INTEGER AS status, count(*) AS unseen, NULL::VARCHAR AS guid FROM events WHERE user_id % 2 = 0")
def feed_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.next_delivery(*_feed(spark, sf_dir))


@query("SELECT event_id::VARCHAR AS guid, ts AS pub_date FROM events WHERE user_id % 2 = 0 ORDER BY ts, event_id DESC LIMIT 1")
def feed_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.oldest(feed.unseen(*_feed(spark, sf_dir))).select("guid", "pub_date")


@query("SELECT event_id::VARCHAR AS guid, ts AS pub_date FROM events ORDER BY ts DESC, event_id LIMIT 3")
def feed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview: the newest three items."""
    return feed.newest(_feed(spark, sf_dir)[0], 3).select("guid", "pub_date")


@query("""
    WITH r AS (SELECT event_id::VARCHAR AS guid, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events)
    SELECT guid, CASE WHEN user_id % 2 = 1 THEN 'sent' ELSE 'seeded' END AS how FROM r WHERE user_id % 2 = 1 OR rank > 3
""")
def feed_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.seeded(*_feed(spark, sf_dir), 3, F.current_timestamp()).select("guid", "how")


@query(r"""
    WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NEW! John ' || event_id % 20 || '. Day ' || event_id % 1200 || ' - Read' ELSE 'Notes on ' || event_type END AS title FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'item-day-' || printf('%03d', event_id % 1200) || '-john-' || event_id % 20 ELSE 'item-' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') END AS slug,
           CASE WHEN event_id % 3 = 0 THEN 'John ' || event_id % 20 || ' — Day ' || event_id % 1200 ELSE title END AS display FROM t
""")
def feed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda n: (F.col("event_id") % n).cast("string")
    title = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("NEW! John "), i(20), F.lit(". Day "), i(1200), F.lit(" - Read"))).otherwise(F.concat(F.lit("Notes on "), "event_type"))
    return table(spark, sf_dir, "events").withColumn("n", feed.names(title)).select("event_id", F.col("n.slug").alias("slug"), F.col("n.display").alias("display"))


# guards


# a minus behind a word is no sign: it becomes a mark that no number holds
_SQL_NUMBER, _SQL_UNIT = r"(?i)[-−]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s+(?:million|billion|trillion)\b)?", r"(?:\s?(?:°c|%|per cent\b|percentage points?\b|mm\b|am\b|pm\b|per\b|years?\b|×))?"


@query(rf"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '(\w)[-−]', '\1~', 'g') AS x FROM documents),
    q AS (SELECT doc_id, x, regexp_extract_all(x, '{_SQL_NUMBER}{_SQL_UNIT}') AS found FROM t),
    norm AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(x, '{_SQL_NUMBER}'), lambda n: trim(regexp_replace(lower(replace(replace(n, '−', '-'), ',', '')), '\s+', ' ', 'g'))))) AS numbers,
        list_sort(list_distinct(list_transform(found, lambda f: trim(regexp_replace(lower(replace(replace(regexp_extract(f, '^{_SQL_NUMBER}'), '−', '-'), ',', '')), '\s+', ' ', 'g')) || '|' ||
            replace(replace(replace(trim(lower(f[length(regexp_extract(f, '^{_SQL_NUMBER}')) + 1:])), 'per cent', '%'), 'percentage points', 'percentage point'), 'percentage point', 'percentage points')))) AS quantities FROM q)
    SELECT doc_id, array_to_string(numbers, ';') AS numbers, array_to_string(list_transform(quantities, lambda x: CASE WHEN ends_with(x, '|year') THEN x || 's' ELSE x END), ';') AS quantities FROM norm
""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", guards.numbers(F.col("text")).alias("numbers"), guards.quantities(F.col("text")).alias("quantities"))
    return found.select("doc_id", F.array_join("numbers", ";").alias("numbers"), F.array_join("quantities", ";").alias("quantities"))


@query(r"""
    SELECT doc_id, regexp_matches(text, '(?i)https?://|www\.|\b[a-z][a-z0-9+.-]*://|\bmailto:') AS has_url, regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+') AS has_mail FROM documents
""")
def guard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(guards.URL).alias("has_url"), F.col("text").rlike(guards.MAIL).alias("has_mail"))


@query(r"""
    WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^!])\(?\[([^\]]*)\]\([^)]*\)\)?', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,;:])', '\1', 'g')) AS t FROM documents),
    r AS (SELECT doc_id, [CASE WHEN regexp_matches(t, '(?i)https?://|www\.|\b[a-z][a-z0-9+.-]*://|\bmailto:') THEN 'url' END,
        CASE WHEN regexp_matches(t, '(?m)<\s*[A-Za-z/!]|\]\(|!\[|(^|[^:/])//\w|\] ?\[|^[ \t>*+\-\d.)]*\[[^\]]+\]:') THEN 'markup' END,
        CASE WHEN regexp_matches(t, '(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)') THEN 'math' END,
        CASE WHEN regexp_matches(t, '[\w.+-]+@[\w-]+\.[\w.-]+') THEN 'link' END,
        CASE WHEN regexp_matches(t, '(?m)^(?:```|~~~| {4}\S)') THEN 'code' END,
        CASE WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) > 600 THEN 'length' END] AS v FROM c)
    SELECT doc_id, array_to_string(list_filter(v, lambda x: x IS NOT NULL), ',') AS violations FROM r
""")
def guard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(guards.violations(F.col("text"), 600), ",").alias("violations"))


# diagrams: orders that share a customer in a month chain into graphs

_SQL_EDGES = "(SELECT DISTINCT c_nationkey % 5 AS graph_id, c_nationkey AS src, c_nationkey + 1 + c_custkey % 7 AS dst FROM customer)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("graph_id"), F.col("c_nationkey").cast("long").alias("src"), (F.col("c_nationkey") + 1 + F.col("c_custkey") % 7).cast("long").alias("dst")).distinct()


@query(f"""
    WITH RECURSIVE e AS (SELECT * FROM {_SQL_EDGES}), p AS (SELECT graph_id, src, dst, 2 AS depth FROM e UNION SELECT p.graph_id, p.src, e.dst, p.depth + 1 FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.dst)
    SELECT graph_id, max(depth)::INTEGER AS depth FROM p GROUP BY graph_id
""")
def graph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.depths(_edges(spark, sf_dir))


@query(f"""
    WITH RECURSIVE e AS (SELECT * FROM {_SQL_EDGES}), p AS (SELECT graph_id, src, dst, 2 AS depth FROM e UNION SELECT p.graph_id, p.src, e.dst, p.depth + 1 FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.dst)
    SELECT graph_id, max(depth)::INTEGER AS depth FROM p GROUP BY graph_id
""")
def graph_depth_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As graph_depth, all graphs relaxed round by round, as large ones are."""
    return diagrams.depths(_edges(spark, sf_dir), folded=0)


@query(f"""
    WITH RECURSIVE e AS (SELECT * FROM {_SQL_EDGES}), p AS (SELECT graph_id, src, dst, 2 AS depth FROM e UNION SELECT p.graph_id, p.src, e.dst, p.depth + 1 FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.dst),
    d AS (SELECT graph_id, max(depth) AS depth FROM p GROUP BY graph_id), f AS (SELECT graph_id, max(k) AS fan FROM (SELECT graph_id, src, count(*) AS k FROM e GROUP BY ALL) GROUP BY graph_id)
    SELECT graph_id, CASE WHEN fan > depth THEN 'LR' ELSE 'TB' END AS direction FROM d JOIN f USING (graph_id)
""")
def graph_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return diagrams.directions(edges.select("graph_id").distinct().withColumn("direction", F.lit("TB")), edges)


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (trim(line) <> '' AND regexp_matches(line, '-->|<--|->|<-|==>|=>|\+-{2,}|-{2,}\+|[─-◿]')) >= 2 AS flow FROM l GROUP BY doc_id
""")
def flow_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", diagrams.is_flow_diagram(F.col("text")).alias("flow"))


# the digest


@query("""
    WITH d AS (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-03-31', INTERVAL 1 DAY))::DATE AS date),
    k AS (SELECT date, date >= DATE '2026-03-01' AND date < DATE '2026-03-08' AS on_break, dayofweek(date) = 0 AS steward FROM d),
    l AS (SELECT date, CASE WHEN on_break AND steward THEN ['notice', 'stewards', 'weather', 'country'] WHEN on_break THEN ['notice', 'weather', 'country']
                 WHEN steward THEN ['stewards', 'weather', 'trains', 'country', 'comparison', 'research', 'scripture'] ELSE ['weather', 'trains', 'country', 'comparison', 'research', 'ai'] END AS keys FROM k),
    u AS (SELECT date, unnest(keys) AS key, unnest(range(len(keys))) AS ord FROM l),
    t AS (SELECT date, ord, CASE WHEN key = 'country' THEN (SELECT n_name FROM nation WHERE n_nationkey = dayofyear(date) % 25) ELSE 'Unavailable today' END AS text FROM u)
    SELECT date, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM t GROUP BY date
""", dates=('date',))
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rotation.dates(spark, "2026-01-01", "2026-03-31").withColumn("on_break", F.col("date").between("2026-03-01", "2026-03-07")).withColumn("steward", F.dayofweek("date") == 1)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("text"))
    texts = days.join(nation, F.dayofyear("date") % 25 == F.col("k")).select("date", F.lit("country").alias("key"), "text")
    return digest.bodies(digest.sections(days, texts))


@query("SELECT c_mktsegment AS category, count(DISTINCT substr(c_name, length(c_name) - 1)) AS n FROM (SELECT substr(c_name, length(c_name) - 1) AS title, min_by(c_mktsegment, c_custkey) AS c_mktsegment, min(c_name) AS c_name FROM customer GROUP BY 1) GROUP BY 1")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.expr("substr(c_name, length(c_name) - 1)")
    return digest.category_counts(table(spark, sf_dir, "customer").select(tail.alias("title"), F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("seq")))


# rules with a state of their own: tested on vectors


@query()
def nested_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents")).select("doc_id", F.md5(folds.nested_lists(F.col("text"))).alias("digest"))


_FENCES = ("", "```py ", "", "```", "~~~", "> ", "> ~~~~", "  ```", "~~~", "text ")
_BARE_FENCES = ("```", "~~~", "> ~~~~", "  ```")
_SQL_MARKS = r"'^((?:[ \t]*>)+[ \t]?|)([ \t]*)(`{3,}|~{3,})(.*)$'"


@query(sql_lines(_FENCES, _BARE_FENCES) + rf"""
    , r AS (SELECT *, regexp_extract(line, {_SQL_MARKS}, 3) AS run, trim(regexp_extract(line, {_SQL_MARKS}, 4)) = '' AS bare, rtrim(regexp_extract(line, {_SQL_MARKS}, 1) || regexp_extract(line, {_SQL_MARKS}, 2)) AS lead, length(regexp_extract(line, {_SQL_MARKS}, 2)) < 2 AS out FROM w),
    h AS (SELECT doc_id, list_reduce(list({{'run': run, 'bare': bare, 'kinds': ''}} ORDER BY i), lambda s, x: {{'run': CASE WHEN s.run = '' THEN x.run WHEN x.bare AND starts_with(x.run, s.run) THEN '' ELSE s.run END, 'bare': false,
        'kinds': s.kinds || CASE WHEN s.run = '' THEN 'o' WHEN x.bare AND starts_with(x.run, s.run) THEN 'c' ELSE 'i' END}}, {{'run': '', 'bare': false, 'kinds': ''}}).kinds AS kinds FROM r WHERE run <> '' GROUP BY doc_id),
    n AS (SELECT r.*, CASE WHEN run <> '' THEN kinds[(sum((run <> '')::INT) OVER (PARTITION BY r.doc_id ORDER BY i))::BIGINT] END AS kind FROM r LEFT JOIN h ON r.doc_id = h.doc_id),
    b AS (SELECT *, lag(kind) OVER o AS kind_before, lag(lead) OVER o AS lead_before, lag(out) OVER o AS out_before FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT doc_id, i, CASE WHEN kind_before = 'c' AND out_before AND NOT regexp_matches(line, '^(?:[ \t]*>)*\s*$') THEN lead_before || chr(10) WHEN kind = 'o' AND out AND NOT regexp_matches(before, '^(?:[ \t]*>)*\s*$') THEN lead || chr(10) ELSE '' END || line AS line FROM b)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p GROUP BY doc_id
""")
def fence_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines open, hold and close fences of several kinds and depths."""
    return marked(table(spark, sf_dir, "documents"), _FENCES, _BARE_FENCES).select("doc_id", F.md5(text.spaced_fences(F.col("text"))).alias("digest"))


_LABELS = ("- **Name (a):** - ", "1. **Part** – ", "* **Open (b** — ", "", "+ **[x)** - ", "- plain - ", "```", "  - **Deep:**   - ", "- **A)(** - ")
_SQL_LABELLED = r"'(?s)^(\s*)((?:[*+-]|\d+\.)\s+)(\*\*[^*]+\*\*:? *?) [-–—] (.*)$'"


def _sql_open(pair: str) -> str:
    steps = f"list_transform(string_split(regexp_extract(line, {_SQL_LABELLED}, 3), ''), lambda c: CASE c WHEN '{pair[0]}' THEN 1 WHEN '{pair[1]}' THEN -1 ELSE 0 END)"
    return f"list_reduce({steps}, lambda n, s: greatest(0, n + s), 0)"


@query(sql_lines(_LABELS, ("```",)) + rf"""
    , p AS (SELECT doc_id, i, CASE WHEN NOT mask AND regexp_matches(line, {_SQL_LABELLED}) AND {_sql_open("()")} = 0 AND {_sql_open("[]")} = 0 THEN regexp_replace(line, {_SQL_LABELLED}, '\1\2\3' || chr(10) || '\1  - \4') ELSE line END AS line FROM w)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p GROUP BY doc_id
""")
def dash_sublists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are items with labels: with brackets that close or stay open, plain ones, and code."""
    return marked(table(spark, sf_dir, "documents"), _LABELS, ("```",)).select("doc_id", F.md5(text.promoted_labels(F.col("text"))).alias("digest"))


_LATEX = ("H_{d}", "x^{{s}}", "\\frac{a}{{s}}", "x_{{s}} + yz^2", "abc_{{s}000}", " \\boxed{a_{{s}}} ", "\\boxed{{s}} and y", "1,{s}00.5", "{d}^_", "\\boxed{{s}}{{d}}", "x_{d}y^3")


def _latex_of(template: str, size: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{s}"), size.cast("string")), F.lit("{d}"), (size % 10).cast("string"))


@query(r"""
    WITH p AS (SELECT p_partkey, p_partkey % 11 AS k, p_size::VARCHAR AS s, (p_size % 10)::VARCHAR AS d FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 'H<sub>' || d || '</sub>' WHEN 1 THEN 'x<sup>' || s || '</sup>' WHEN 3 THEN 'x<sub>' || s || '</sub> + yz<sup>2</sup>' WHEN 10 THEN 'x<sub>' || d || '</sub>y<sup>3</sup>' END AS scripts,
           CASE WHEN k = 5 THEN 'a_{' || s || '}' END AS unboxed, k <> 7 AS is_math FROM p
""")
def latex_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of mathematics made of the parts' sizes: which are but scripts, which are boxed, which are mathematics at all."""
    size, k = F.col("p_size"), F.col("p_partkey") % len(_LATEX)
    made = F.element_at(F.array(*[_latex_of(t, size) for t in _LATEX]), (k + 1).cast("int"))
    pieces = table(spark, sf_dir, "part").select("p_partkey", made.alias("x")).withColumn("box", latex.unboxed(F.col("x")))
    return pieces.select("p_partkey", latex.scripts(F.col("x")).alias("scripts"), F.when(F.col("box.boxed"), F.col("box.latex")).alias("unboxed"), latex.looks_like_math(F.col("x")).alias("is_math"))


@query()
def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", folds.math(F.col("text")).alias("spans"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = marked(table(spark, sf_dir, "documents")).withColumn("format", F.lit("md"))
    return convert.blocks(convert.documents(raw))


@query(SQL_LINES + """
    , em AS (SELECT doc_id, i, unnest(regexp_extract_all(line, '✅|⚠️?')) AS mark FROM w), o AS (SELECT doc_id, mark, min(i) AS first FROM em GROUP BY ALL),
    l AS (SELECT doc_id, string_agg(mark, ' ' ORDER BY first) AS emoji FROM o GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(l.emoji, '') AS emoji FROM documents LEFT JOIN l ON l.doc_id = documents.doc_id
""")
def text_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(text.emoji(F.col("text")), " ").alias("emoji"))
