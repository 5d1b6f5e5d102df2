"""Queries over landed pages: rows of the tables are put into the shape that a page has, and read back from it; the SQL asks the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import guards, hours
from inkwell.plans.registry import query, table
from inkwell.sources import readers

_SQL_YEARS = "(SELECT n_name, year(o_orderdate)::INTEGER AS year, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_name, year, n): orders of each nation and year."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("n"))


@query(f"SELECT 'ORDERS' AS indicator, n_name AS entity, year, n AS value FROM {_SQL_YEARS} WHERE year % 5 <> 0 AND n_name IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def landed_bank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a nation, numbers as text, nulls for every fifth year, read for every other nation."""
    row = F.struct(F.struct(F.lit("ORDERS").alias("id")).alias("indicator"), F.col("n_name").alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.when(F.col("year") % 5 != 0, F.col("n").cast("string")).alias("value"))
    pages = _years(spark, sf_dir).groupBy("n_name").agg(F.to_json(F.collect_list(row), {"ignoreNullFields": "false"}).alias("rows"))
    wanted = [r.n_name for r in table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_name").collect()]  # nations
    return readers.world_bank(pages.select(F.concat(F.lit('[{"page":1},'), "rows", F.lit("]")).alias("json")), wanted)


@query(f"SELECT 'ORDERS' AS indicator, n_name AS entity, year, n AS value FROM {_SQL_YEARS} WHERE year <= 1999")
def landed_fund_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of maps by nation and year; later years are projections."""
    years = F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), "n")))
    nations = _years(spark, sf_dir).groupBy("n_name").agg(years.alias("years"))
    pages = nations.groupBy(F.pmod(F.hash("n_name"), F.lit(4))).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "years"))).alias("m"))
    return readers.imf(pages.select(F.to_json(F.struct(F.struct(F.col("m").alias("ORDERS")).alias("values"))).alias("json")), 1999)


@query(f"SELECT n_name AS entity, year, n AS value FROM {_SQL_YEARS} WHERE year <= 2000")
def landed_health_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three dimensions a nation and year, one of which is asked for."""
    kinds = F.explode(F.array(F.lit("BTSX"), F.lit("MLE"), F.lit("FMLE"))).alias("kind")
    rows = _years(spark, sf_dir).select("*", kinds)
    row = F.struct(F.col("n_name").alias("SpatialDim"), F.col("year").alias("TimeDim"), F.col("kind").alias("Dim1"), F.when(F.col("kind") == "BTSX", F.col("n")).otherwise(-1.0).alias("NumericValue"))
    pages = rows.groupBy("n_name").agg(F.collect_list(row).alias("value"))
    return readers.who(pages.select(F.to_json(F.struct("value")).alias("json")), 2000, None, {"Dim1": "BTSX"})


@query("""
    WITH h AS (SELECT date_trunc('hour', ts) AS t, (max(event_id) % 101)::DOUBLE AS chance, (count(*) % 7) / 4.0 AS mm, (sum(event_id) % 100)::INTEGER AS code FROM events GROUP BY ALL)
    SELECT (t - INTERVAL 1 HOUR)::VARCHAR AS t, chance, mm::DOUBLE AS mm, code FROM h
""")
def landed_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a day of parallel arrays in a zone an hour before UTC."""
    by = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.date_trunc("hour", "ts").alias("t"))
    hour = by.agg((F.max("event_id") % 101).cast("double").alias("chance"), ((F.count(F.lit(1)) % 7) / 4.0).alias("mm"), (F.sum("event_id") % 100).cast("int").alias("code"))
    rows = F.array_sort(F.collect_list(F.struct("t", "chance", "mm", "code")))
    days = hour.groupBy(F.to_date("t").alias("day")).agg(rows.alias("r"))
    part = lambda f, name: F.transform("r", f).alias(name)
    hourly = F.struct(part(lambda r: F.date_format(r["t"], "yyyy-MM-dd'T'HH:mm"), "time"), part(lambda r: r["chance"], "precipitation_probability"), part(lambda r: r["mm"], "precipitation"), part(lambda r: r["code"], "weather_code"))
    pages = days.select(F.to_json(F.struct(F.lit(3600).alias("utc_offset_seconds"), hourly.alias("hourly"))).alias("json"))
    return readers.hourly(pages).withColumn("t", F.col("t").cast("string"))


@query(r"""
    WITH p AS (SELECT page_id, 'T ' || page_id AS title, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS h, CASE WHEN page_id % 3 <> 2 THEN 'one two  three ' || page_id || ' five' END AS lead, page_id % 7 = 0 OR trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) = '' AS bad FROM pages)
    SELECT page_id::VARCHAR AS key, CASE WHEN NOT bad THEN CASE WHEN page_id % 2 = 0 THEN 'N ' || title ELSE title END END AS title,
           CASE WHEN bad THEN NULL WHEN lead IS NULL THEN h ELSE 'one two three ' || page_id END AS extract, CASE WHEN NOT bad THEN 'https://w/' || page_id END AS url,
           CASE WHEN bad THEN 'no usable extract' END AS error, CASE WHEN NOT bad AND lead IS NULL THEN 'full lead unavailable; used the summary paragraph only' END AS note FROM p
""")
def landed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries made of all pages' headings: some that only tell terms apart, some without a longer lead."""
    pages = table(spark, sf_dir, "pages").withColumn("key", F.col("page_id").cast("string"))
    own = F.concat(F.lit("T "), "key")
    kind = F.when(F.col("page_id") % 7 == 0, "disambiguation").otherwise("standard").alias("type")
    names = F.when(F.col("page_id") % 2 == 0, F.struct(F.concat(F.lit("N "), own).alias("normalized"))).alias("titles")
    page = F.struct(kind, own.alias("title"), names, F.concat(F.lit(" "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("\n")).alias("extract"), F.struct(F.struct(F.concat(F.lit("https://w/"), "key").alias("page")).alias("desktop")).alias("content_urls"))
    lead = pages.where("page_id % 3 <> 2").select("key", F.concat(F.lit("one two  three "), "key", F.lit(" five")).alias("lead"))
    return readers.leads(readers.summaries(pages.select("key", F.to_json(page).alias("json"))), lead, 4)


@query("""
    WITH a AS (SELECT conv_id, turn, text AS content, CASE WHEN role = 'assistant' THEN turn END AS good FROM conversations)
    SELECT conv_id, arg_min(content, good) AS content, CASE WHEN min(good) IS NULL THEN 'talk: ' || CASE WHEN max(turn) % 2 = 0 THEN 'TimeoutError' ELSE 'HTTPError ' || (400 + max(turn)) END END AS error FROM a GROUP BY conv_id
""")
def landed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as attempts, of which only an assistant's brings something."""
    turns = table(spark, sf_dir, "conversations")
    failed = F.col("role") != "assistant"
    odd = F.col("turn") % 2 == 1
    attempts = turns.select("conv_id", F.col("turn").alias("attempt"), F.when(~failed, F.col("text")).alias("content"), F.when(odd, "HTTPError").otherwise("TimeoutError").alias("kind"), F.when(odd, F.col("turn") + 400).cast("int").alias("code"))
    return readers.best_attempts(attempts, ["conv_id"], F.lit("talk"))


@query("""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'HTTP ' || (400 + page_id % 100) WHEN page_id % 5 = 1 THEN 'no body' WHEN octet_length(encode(html)) > 9000 THEN 'too large' END AS error,
           page_id % 5 > 1 AND octet_length(encode(html)) <= 9000 AS kept FROM pages
""")
def landed_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    fetches = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k == 0, 400 + F.col("page_id") % 100).otherwise(200).cast("int").alias("status"), F.when(k != 1, F.encode("html", "UTF-8")).alias("content"))
    return readers.fetched(fetches, 9000).select("page_id", "error", F.col("content").isNotNull().alias("kept"))


_MAGIC = ("89504E470D0A1A0A00", "FFD8FF00", "474946383961", "424D0000", "524946460000000057454250", "3C7376673E", "0000")


@query(f"""
    WITH p AS (SELECT page_id, page_id % 7 AS k, page_id % 11 AS s, 'pic ' || page_id AS alt, url FROM pages),
    j AS (SELECT *, ['image/png', 'image/jpeg', 'image/gif', 'image/bmp', 'image/webp', 'image/svg+xml', NULL][k + 1] AS kind FROM p)
    SELECT page_id, CASE WHEN s > 1 THEN kind END AS media_type, CASE WHEN s = 0 THEN 'timeout' WHEN s = 1 THEN 'HTTP 404' WHEN kind IS NULL THEN 'corrupt image data' END AS reason,
           CASE WHEN s < 2 OR kind IS NULL THEN '[Image could not be loaded: ' || left(CASE WHEN page_id % 2 = 0 THEN alt ELSE url END, 60) || ']' END AS placeholder FROM j
""")
def landed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that begin like images of each kind, and some that failed."""
    k, s = F.col("page_id") % len(_MAGIC), F.col("page_id") % 11
    body = F.unhex(F.element_at(F.array(*map(F.lit, _MAGIC)), (k + 1).cast("int")))
    kind = F.when(k == 5, "image/svg+xml").otherwise("image/png; q=1")
    alt = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("pic "), F.col("page_id").cast("string"))).otherwise(" ")
    image = readers.image_of(F.col("url"), F.when(s == 1, 404).otherwise(200), kind, body, alt, F.when(s == 0, "timeout"))
    return table(spark, sf_dir, "pages").withColumn("i", image).select("page_id", "i.media_type", "i.reason", "i.placeholder")


@query(r"""
    WITH p AS (SELECT page_id, url, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS h, TIMESTAMP '2026-01-02 03:04:05' + INTERVAL 1 MINUTE * page_id AS put FROM pages),
    s AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[:60], '') AS slug, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[:60], ''), 'page') AS bare FROM p)
    SELECT page_id, coalesce(slug, 'pasted') || '_' || strftime(put, '%Y%m%d_%H%M%S') || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.html' ELSE '.txt' END AS pasted,
           'url_' || CASE WHEN page_id % 2 = 0 AND slug IS NOT NULL THEN slug ELSE bare END || '_' || CASE WHEN page_id % 4 = 0 THEN '2025-12-31_' ELSE '' END || strftime(put, '%Y%m%d_%H%M%S') || '.html' AS fetched FROM s
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files for all pages, pasted and fetched, with a title and without."""
    i, title = F.col("page_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    at = F.lit("2026-01-02 03:04:05").cast("timestamp") + F.make_dt_interval(mins=i.cast("int"))
    fmt = F.when(i % 3 == 0, "md").when(i % 3 == 1, "html").otherwise("txt")
    fetched = readers.fetched_name(F.when(i % 2 == 0, title), F.col("url"), F.when(i % 4 == 0, "2025-12-31"), at)
    return table(spark, sf_dir, "pages").select("page_id", readers.pasted_name(title, fmt, at).alias("pasted"), fetched.alias("fetched"))


@query("""
    WITH i AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_partkey, o_orderdate::DATE AS date, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT *, l_returnflag <> 'N' AS bad, CASE WHEN l_partkey % 3 = 0 THEN true ELSE l_shipdate < timezone('UTC', timezone('Europe/London', date + INTERVAL 1 DAY)) AND l_shipdate + INTERVAL 400 DAY > timezone('UTC', timezone('Europe/London', date::TIMESTAMP)) END AS holds, CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '- list' ELSE 'Closed ' || l_suppkey % 7 END AS reason FROM i),
    k AS (SELECT l_orderkey, seq, reason, bad AND holds AND reason <> '' AND reason <> '- list' AS kept, bad AND holds AND reason IN ('', '- list') AS lost FROM s),
    u AS (SELECT l_orderkey, reason, min(seq) AS seq FROM k WHERE kept GROUP BY ALL),
    n AS (SELECT l_orderkey, string_agg(reason, ';' ORDER BY seq) AS notices FROM u GROUP BY ALL)
    SELECT l_orderkey, coalesce(notices, '') AS notices, sum(lost::INT)::INTEGER AS dropped FROM k LEFT JOIN n USING (l_orderkey) GROUP BY ALL
""")
def landed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order, whose items are statuses that hold for a time; what overlaps the order's day in London and may be shown."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    begins = F.col("l_shipdate").cast("timestamp")
    period = F.struct(stamp(begins).alias("fromDate"), stamp(begins + F.expr("interval 400 days")).alias("toDate"))
    reason = F.when(F.col("l_suppkey") % 5 == 0, " ").when(F.col("l_suppkey") % 5 == 1, "- list").otherwise(F.concat(F.lit(" Closed "), (F.col("l_suppkey") % 7).cast("string")))
    severity = F.when(F.col("l_returnflag") == "N", "Good Service").otherwise("Part Closure")
    status = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(severity.alias("statusSeverityDescription"), reason.alias("reason"), F.when(F.col("l_partkey") % 3 == 0, F.array().cast("array<struct<fromDate:string,toDate:string>>")).otherwise(F.array(period)).alias("validityPeriods")).alias("s"))
    pages = items.groupBy("l_orderkey", F.to_date("o_orderdate").alias("date")).agg(F.transform(F.array_sort(F.collect_list(status)), lambda x: x["s"]).alias("lineStatuses"))
    landed = pages.select("l_orderkey", "date", F.to_json(F.array(F.struct("lineStatuses"))).alias("json"))
    found = hours.line_status(landed, guards.safe_notice, ["l_orderkey"])
    return found.select("l_orderkey", F.array_join("notices", ";").alias("notices"), "dropped")
