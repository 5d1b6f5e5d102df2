"""Queries of whole sections, documents and paginated pages, made of rows of the tables; the SQL writes the same texts by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import escaped
from inkwell.operators import digest, rotation, sections, xhtml
from inkwell.plans.registry import query, table
from inkwell.sources import readers

L, NL = F.lit, "chr(10)"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _share_sql(r: str) -> str:
    return f"CASE WHEN {r} >= 1 THEN printf('%.1f× the UK''s', {r}) WHEN {r} * 100 >= 10 THEN printf('%.0f%% of the UK''s', {r} * 100) WHEN {r} * 100 >= 1 THEN printf('%.1f%% of the UK''s', {r} * 100) ELSE printf('%.2g%% of the UK''s', {r} * 100) END"


@query(f"""
    WITH c AS (SELECT c_custkey, c_custkey % 3 AS k, c_acctbal AS hv, c_custkey * 1.5 AS ov, 1995 + c_custkey % 5 AS hy, 1995 + c_custkey % 4 AS oy, c_custkey % 5 = 0 AS searched, c_custkey % 7 = 0 AS lacking, c_custkey % 11 <> 0 AS same, c_custkey % 13 = 0 AS wide, c_custkey % 2 = 0 AS estimate, c_mktsegment FROM customer),
    d AS (SELECT *, hv / 1e2 AS px, round(printf('%.1f', ov)::DOUBLE * 10)::BIGINT - round(printf('%.1f', hv)::DOUBLE * 10)::BIGINT AS d FROM c),
    f AS (SELECT *, CASE k WHEN 0 THEN printf('%.1f%%', hv) WHEN 1 THEN printf('%.3f', hv) END AS ht, CASE k WHEN 0 THEN printf('%.1f%%', ov) WHEN 1 THEN printf('%.3f', ov) END AS ot, CASE WHEN estimate THEN ', may be an IMF estimate' ELSE '' END AS est FROM d),
    t AS (SELECT *, CASE WHEN k = 2 THEN hy::VARCHAR ELSE ht || ' heads (' || hy || ')' END || ' (Bank data)' AS home, CASE WHEN lacking THEN 'not available today' ELSE CASE WHEN k = 2 THEN oy::VARCHAR ELSE ot || ' heads (' || oy || ')' END || ' (' || CASE WHEN searched THEN 'found by an AI web search of s.org (Office)' || est || '; it counts: all.' ELSE 'Bank data' || est END || ')' END AS other,
        CASE WHEN lacking OR k = 2 THEN '' WHEN NOT same THEN 'counted by hand' WHEN wide THEN 'a figure comes from a different source, so definitions may differ' WHEN k <> 0 AND hv <= 0 THEN 'the UK figure is not positive, so no ratio can be given' ELSE '' END AS reason FROM f),
    r AS (SELECT *, CASE WHEN NOT lacking AND k <> 2 AND reason = '' AND hv <> 0 THEN CASE WHEN k = 0 THEN CASE WHEN d = 0 THEN 'the same as the UK''s' ELSE printf('%.1f', abs(d) / 10.0) || ' percentage points ' || CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END || ' than the UK''s' END ELSE {_share_sql('(ov / hv)')} END END AS relation FROM t)
    SELECT c_custkey, concat_ws({NL}, 'FACT: ' || c_mktsegment, 'MEANING: A share.', 'UK: ' || home, 'JAMAICA: ' || other, CASE WHEN relation IS NOT NULL THEN 'RELATION: ' || relation WHEN reason <> '' THEN 'COMPARABILITY: not compared: ' || reason END,
        CASE WHEN NOT lacking AND k <> 2 AND hy <> oy THEN 'NOTE: the figures are from different years (Jamaica ' || oy || ', UK ' || hy || ')' END) AS block FROM r
""")
def fact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of a fact for each customer: their balance and a number of their own as two countries' figures."""
    i, k = F.col("c_custkey"), F.col("c_custkey") % 3
    fmt = F.when(k == 0, "pct").when(k == 1, "index").otherwise("year")
    entry = F.struct(F.col("c_mktsegment").alias("label"), L("A share.").alias("meaning"), fmt.alias("format"), L("heads").alias("unit"), L("Bank").alias("org"), L("X").alias("code"), L("worldbank").alias("source"), (i % 11 != 0).alias("harmonised"), L("counted by hand").alias("not_compared_because"))
    none = L(None).cast("string")
    home = F.struct(F.col("c_acctbal").alias("value"), (1995 + i % 5).cast("int").alias("year"), L("api").alias("via"), L(False).alias("estimate"), none.alias("unit_note"), L("https://b.org").alias("url"), L("Bank").alias("org"), L(None).cast("int").alias("tier"))
    searched = i % 5 == 0
    other = F.struct((i * 1.5).alias("value"), (1995 + i % 4).cast("int").alias("year"), F.when(searched, "search").otherwise("api").alias("via"), (i % 2 == 0).alias("estimate"), L("all.").alias("unit_note"), L("https://www.s.org/p").alias("url"), L("Office").alias("org"), F.when(i % 13 == 0, 2).alias("tier"))
    return table(spark, sf_dir, "customer").select("c_custkey", sections.fact_block(entry, home, F.when(i % 7 != 0, other)).alias("block"))


@query("""
    WITH e AS (SELECT user_id, ts::DATE AS date, event_id, ts, ['light', 'moderate', 'heavy'][event_id % 3 + 1] AS intensity, ['rain', 'snow', 'showers', 'drizzle'][event_id % 4 + 1] AS kind, event_id % 2 = 0 AS likely,
        CASE event_id % 5 WHEN 0 THEN ['morning'] WHEN 1 THEN ['morning', 'afternoon'] WHEN 2 THEN ['evening'] WHEN 3 THEN ['late evening'] ELSE ['early morning', 'morning'] END AS parts, floor(value)::INTEGER AS peak FROM events),
    l AS (SELECT *, intensity || ' ' || kind AS what, CASE WHEN likely THEN 'likely' ELSE 'possible' END AS sure, 'in the ' || array_to_string(parts, ' and ') AS place FROM e),
    u AS (SELECT user_id, date, part, count(*) AS n FROM (SELECT user_id, date, unnest(parts) AS part FROM l) GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT user_id, date, string_agg(part, ', ' ORDER BY list_position(['early morning', 'morning', 'afternoon', 'evening', 'late evening'], part)) AS often FROM u GROUP BY ALL),
    g AS (SELECT user_id, date, string_agg('- ' || what || ', ' || sure || ', ' || place || ', from ' || strftime(ts, '%H:%M') || ' to ' || strftime(ts + INTERVAL 1 HOUR, '%H:%M') || ', peak chance ' || peak || '%', chr(10) ORDER BY ts) AS lines,
        string_agg(what || ' ' || sure || ' ' || place, ' and ' ORDER BY ts) AS said, bool_or(intensity = 'heavy') AS heavy FROM l GROUP BY ALL)
    SELECT user_id, date::VARCHAR AS date, md5(concat_ws(chr(10), 'SKY (07:00 to 19:00): mostly sunny', 'FEELS: mild', 'HIGH: ' || day(date) || '°C', 'LOW: 3°C', 'RAIN SPELLS:' || chr(10) || lines, 'ON AND OFF: ' || often, CASE WHEN heavy THEN 'HEAVY: yes' END, 'SUNRISE: 06:00', 'SUNSET: 20:00')) AS block,
        'Mostly sunny and mild, with ' || said || '. A high of ' || day(date) || '°C.' AS sentence FROM g LEFT JOIN o USING (user_id, date)
""")
def weather_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather writer's block, and the sentence in its place, for each user and day, whose events are wet spells."""
    i = F.col("event_id")
    pick = lambda xs, n: F.element_at(F.array(*map(L, xs)), (i % n + 1).cast("int"))
    parts = F.when(i % 5 == 0, F.array(L("morning"))).when(i % 5 == 1, F.array(L("morning"), L("afternoon"))).when(i % 5 == 2, F.array(L("evening"))).when(i % 5 == 3, F.array(L("late evening"))).otherwise(F.array(L("early morning"), L("morning")))
    at = F.col("ts").cast("timestamp")
    spell = F.struct(at.alias("start"), (at + F.expr("interval 1 hour")).alias("end"), pick(("light", "moderate", "heavy"), 3).alias("intensity"), pick(("rain", "snow", "showers", "drizzle"), 4).alias("kind"), (i % 2 == 0).alias("likely"), F.floor("value").cast("int").alias("peak_chance"), parts.alias("parts"))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.array_sort(F.collect_list(spell)).alias("spells"))
    day = F.struct(L("mostly sunny").alias("sky"), L("mild").alias("feel"), F.concat(_s(F.dayofmonth("date")), L("°C")).alias("high"), L("3°C").alias("low"), L("06:00").alias("sunrise"), L("20:00").alias("sunset"), F.col("spells"))
    block = sections.weather_block(day, lambda t: F.date_format(t, "HH:mm"))
    return days.select("user_id", _s("date").alias("date"), F.md5(block).alias("block"), sections.weather_sentence(day).alias("sentence"))


@query("""
    WITH o AS (SELECT o_orderdate::DATE AS date, min(o_orderpriority) AS a, max(o_custkey) AS b, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT date, 0 AS ord, 'ai' AS key, 'Engineering' AS name, '## ' || a AS text FROM o UNION ALL SELECT date, 1, 'trains', 'Trains', CASE WHEN b % 3 = 0 THEN '*Unavailable today: trains. See the run check above.*' ELSE '## Line ' || b END FROM o UNION ALL SELECT date, 2, 'x', 'Other', 'n ' || n FROM o),
    r AS (SELECT date, CASE WHEN day(date) % 2 = 0 THEN 'trains' ELSE 'ai' END AS key, '> **AI reviewer note:** Odd' || CASE WHEN day(date) % 3 = 0 THEN '!' ELSE '.' END || ' Reviewer''s source: [a.org](https://a.org). The text above follows its cited source; this note is the AI reviewer''s own view and may be wrong.' AS said FROM o WHERE day(date) % 5 <> 0),
    w AS (SELECT s.date, ord, name, text || CASE WHEN said IS NOT NULL AND NOT contains(text, '*Unavailable today') THEN chr(10) || chr(10) || said ELSE '' END AS text, said IS NOT NULL AND NOT contains(text, '*Unavailable today') AS noted FROM s LEFT JOIN r ON r.date = s.date AND r.key = s.key),
    d AS (SELECT date, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body, string_agg(name, ', ' ORDER BY ord) FILTER (noted) AS names FROM w GROUP BY date)
    SELECT date::VARCHAR AS date, '# Day' || chr(10) || chr(10) || strftime(date, '%d') || coalesce(chr(10) || chr(10) || '> **Run check — warning:** AI reviewer disagrees with a sourced claim in: ' || names || '.', '') || chr(10) || chr(10) || body || chr(10) AS document FROM d
""")
def day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each day of orders: three sections, a reviewer's note on one of them, and the box that points to it."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderpriority").alias("a"), F.max("o_custkey").alias("b"), F.count(L(1)).alias("n"))
    none = F.array().cast("array<string>")
    heads = days.select("date", L("Day").alias("title"), F.date_format("date", "dd").alias("dated"), L("ok").alias("status"), none.alias("review_notes"), none.alias("diagnostics"))
    part = lambda ord_, key, name, text: F.struct(L(ord_).alias("ord"), L(key).alias("key"), L(name).alias("name"), text.alias("text"))
    trains = F.when(F.col("b") % 3 == 0, sections.missing("trains")).otherwise(F.concat(L("## Line "), _s("b")))
    parts = days.select("date", F.explode(F.array(part(0, "ai", "Engineering", F.concat(L("## "), "a")), part(1, "trains", "Trains", trains), part(2, "x", "Other", F.concat(L("n "), _s("n"))))).alias("p")).select("date", "p.*")
    d = F.dayofmonth("date")
    notes = days.where(d % 5 != 0).select("date", F.when(d % 2 == 0, "trains").otherwise("ai").alias("section"), L(1).alias("seq"), F.when(d % 3 == 0, "Odd!").otherwise("Odd").alias("note"), L("https://a.org").alias("url"))
    return sections.documents(heads, parts, notes).select(_s("date").alias("date"), "document")


@query("""
    WITH n AS (SELECT n_nationkey AS k, n_name, r_name, n_nationkey * 1000000.0 + 500 AS people, n_nationkey * 10 + 100 AS land FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT k, concat_ws(chr(10) || chr(10), '## Flag of the Day: ' || n_name, CASE WHEN k % 3 = 0 THEN '*Flag image unavailable today.*' ELSE '![Flag of ' || n_name || '](f' || k || '.png)' END,
        concat_ws(chr(10), '| Country | ' || n_name || ' |', '|---|---|', '| Region | ' || r_name || CASE WHEN k % 2 = 0 THEN ' · Part ' || k ELSE '' END || ' |', '| Capital | ' || CASE WHEN k % 4 = 0 THEN '—' ELSE 'City, Town' END || ' |', '| Currency | Coin |',
            '| Population | ' || CASE WHEN k % 5 = 0 THEN 'unavailable today' WHEN people >= 1e6 THEN rtrim(rtrim(printf('%.2f', people / 1e6), '0'), '.') || ' million (2020)' ELSE format('{:,.0f}', people) || ' (2020)' END || ' |', '| vs UK | ' || CASE WHEN k % 5 = 0 THEN 'unavailable today' WHEN k = 1 THEN '— (this is the UK)' ELSE """ + _share_sql("(people / 67000000.0)") + """ || ' (2020)' END || ' |', '| Land area | ' || land || ' km² (2021) |'),
        CASE WHEN k <> 1 THEN CASE WHEN k % 2 = 0 THEN '**Size vs UK:** smaller' ELSE '*UK comparison unavailable today.*' END END, CASE WHEN k % 6 = 0 THEN '*Unavailable today: the country description. See the run check above.*' ELSE 'About ' || n_name END,
        'Sources: ' || concat_ws(' · ', CASE WHEN k % 6 <> 0 THEN '[Wikipedia](https://w/' || k || ')' END, CASE WHEN k % 5 <> 0 THEN '[World Bank population](https://data.worldbank.org/indicator/SP.POP.TOTL?locations=C' || k || ')' END, '[World Bank land area](https://data.worldbank.org/indicator/AG.LND.TOTL.K2?locations=C' || k || ')')) AS section FROM n
""")
def flag_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country's section for each nation; nation 1 is at home."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    country = F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.when(k % 2 == 0, F.concat(L("Part "), _s(k))).otherwise("").alias("subregion"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(L("City"), L("Town"))).alias("capital"), F.array(L("Coin")).alias("currencies"), F.concat(L("C"), _s(k)).alias("cca2"), F.when(k == 1, "GBR").otherwise("X").alias("cca3"))
    people = F.when(k % 5 != 0, F.struct((k * 1000000.0 + 500).alias("value"), L(67000000.0).alias("home"), L(2020).alias("year")))
    land = F.struct((k * 10.0 + 100).alias("value"), L(243610.0).alias("home"), L(2021).alias("year"))
    made = sections.flag_section(country, F.when(k % 3 != 0, F.concat(L("f"), _s(k), L(".png"))), people, land, F.when(k % 2 == 0, "smaller"), F.when(k % 6 != 0, F.concat(L("About "), "n_name")), F.concat(L("https://w/"), _s(k)))
    return both.select(k.alias("k"), made.alias("section"))


@query("""
    SELECT DISTINCT o_orderdate::DATE::VARCHAR AS date, '> **Break day — Day ' || day(o_orderdate) || '.** No study today. Back on ' || strftime(o_orderdate::DATE + 2, '%A %-d %B') || '.' AS rest,
        '## Stewards on Duty' || chr(10) || chr(10) || CASE day(o_orderdate) % 4 WHEN 0 THEN '**Red team** (Ann, Ben) — **you are on duty today.**' WHEN 1 THEN '**Red team** (Ann, Ben). You are not on duty.' WHEN 2 THEN 'No team on duty: Fair. You are not on duty.' ELSE '> **No rota**' END || CASE WHEN day(o_orderdate) % 5 = 0 THEN chr(10) || chr(10) || '> **Ask soon**' ELSE '' END AS stewards FROM orders
""")
def day_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A break's and the stewards' section for each day of orders."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    d = F.dayofmonth("date")
    on = (d % 4).isin(0, 1)
    stewards = sections.stewards_section(F.when(on, "Red"), F.when(on, "Ann, Ben"), d % 4 == 0, F.when(d % 4 == 2, "Fair"), L("No rota"), F.when(d % 5 == 0, "Ask soon").otherwise(""))
    return days.select(_s("date").alias("date"), sections.break_section(F.concat(L("Day "), _s(d)), F.date_add("date", 2)).alias("rest"), stewards.alias("stewards"))


@query("""
    SELECT o_orderkey, o_orderkey % 9 AS k FROM orders WHERE o_orderkey % 9 IN (0, 1) OR o_orderkey % 9 = 2 OR o_custkey % 5 < 2
""")
def calendar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of a calendar: some without a name or a date, some that end before they start."""
    i = F.col("o_orderkey") % 9
    date = F.to_date("o_orderdate")
    entries = table(spark, sf_dir, "orders").select("o_orderkey", i.alias("k"), F.when(i == 0, " ").when(i > 0, "Name").alias("name"), F.when(i != 1, date).alias("start"), F.when(i != 2, F.date_add(date, (F.col("o_custkey") % 5 - 2).cast("int"))).alias("end"))
    return readers.break_faults(entries).select("o_orderkey", "k")


@query("""
    WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey ELSE 'd' || o_custkey END AS date, CASE WHEN o_orderkey % 4 <> 1 THEN 'Team ' || o_custkey % 5 END AS team, CASE o_orderkey % 4 WHEN 1 THEN 'see www.x.org' WHEN 2 THEN 'both' END AS note FROM orders),
    c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM r)
    SELECT date, team, note, concat_ws(',', CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN (team IS NULL) = (note IS NULL) THEN 'one of team and note' END, CASE WHEN note LIKE '%www%' THEN 'text' END) AS faults FROM c WHERE n > 1 OR (team IS NULL) = (note IS NULL) OR note LIKE '%www%'
""")
def rota_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    rota = table(spark, sf_dir, "orders").select(F.concat(L("d"), F.when(i % 3 == 0, _s(i)).otherwise(_s("o_custkey"))).alias("date"), F.when(i % 4 != 1, F.concat(L("Team "), _s(F.col("o_custkey") % 5))).alias("team"), F.when(i % 4 == 1, "see www.x.org").when(i % 4 == 2, "both").alias("note"))
    return readers.rota_faults(rota).select("date", "team", "note", F.array_join("faults", ",").alias("faults"))


@query("""
    WITH s AS (SELECT l_suppkey AS doc_id, l_orderkey % 50 AS block, l_partkey AS pos, l_returnflag || l_linenumber AS text, 8 + l_quantity % 7 AS size, l_linenumber % 2 = 0 AS bold FROM lineitem),
    b AS (SELECT doc_id, block, string_agg(text, ' ' ORDER BY pos, text) AS text, median(size) AS size, avg(bold::INT) > 0.5 AS bold FROM s GROUP BY ALL), m AS (SELECT doc_id, median(size) AS body FROM s GROUP BY ALL)
    SELECT doc_id, block, text, size, bold, CASE WHEN size / body >= 1.5 THEN 1 WHEN size / body >= 1.25 THEN 2 WHEN size / body >= 1.1 OR (bold AND size / body >= 1) THEN 3 END::INTEGER AS level FROM b JOIN m USING (doc_id)
""")
def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans of a document a supplier: blocks with their text, size and heading level."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 50).alias("block"), F.col("l_partkey").alias("pos"), F.concat("l_returnflag", _s("l_linenumber")).alias("text"), (8 + F.col("l_quantity") % 7).alias("size"), (F.col("l_linenumber") % 2 == 0).alias("bold"))
    return readers.spans_to_blocks(spans)


_SQL_PAGE = "SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey * 1000000 + l_partkey * 100 + l_quantity::BIGINT AS id, l_partkey % 5 AS k, l_returnflag AS flag, (l_partkey * 37 % 400)::DOUBLE AS x0, (l_orderkey * 13 % 600)::DOUBLE AS y0, l_partkey * 37 % 400 + l_quantity * 3 AS x1, l_orderkey * 13 % 600 + l_quantity * 2 + 4 AS y1 FROM lineitem"


@query(f"""
    WITH a AS ({_SQL_PAGE}), t AS (SELECT * FROM a WHERE flag = 'R' AND k = 0), b AS (SELECT * FROM a WHERE NOT (flag = 'R' AND k = 0)),
    c AS (SELECT DISTINCT b.doc_id, b.id FROM b JOIN t ON t.doc_id = b.doc_id AND t.page = b.page WHERE least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0) AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0)),
    e AS (SELECT doc_id, page, y0, CASE WHEN k = 1 THEN '<h2>' || id || ' &lt;' || flag || '</h2>' ELSE '<p>' || id || ' &lt;' || flag || '</p>' END AS html FROM b ANTI JOIN c USING (doc_id, id) UNION ALL SELECT doc_id, page, y0, '<table><tbody><tr><td>' || id || '</td><td></td></tr></tbody></table>' FROM t)
    SELECT doc_id, md5(string_agg(html, '' ORDER BY page, y0, html)) AS digest FROM e GROUP BY doc_id
""")
def paginated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks and tables of paginated documents: what a table covers is its own, the rest is HTML in reading order."""
    q = F.col("l_quantity")
    x, y = (F.col("l_partkey") * 37 % 400).cast("double"), (F.col("l_orderkey") * 13 % 600).cast("double")
    i = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + q.cast("long")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), i.alias("id"), (F.col("l_partkey") % 5).alias("k"), "l_returnflag", x.alias("x0"), y.alias("y0"), (x + q * 3).alias("x1"), (y + q * 2 + 4).alias("y1"))
    tabled = (F.col("l_returnflag") == "R") & (F.col("k") == 0)
    corners = ["x0", "y0", "x1", "y1"]
    blocks = items.where(~tabled).select("doc_id", "page", F.col("id").alias("block"), F.concat(_s("id"), L(" <"), "l_returnflag").alias("text"), F.when(F.col("k") == 1, 2).alias("level"), *corners)
    tables = items.where(tabled).select("doc_id", "page", F.col("id").alias("table"), F.array(F.array(_s("id"), L(None).cast("string"))).alias("rows"), *corners)
    return readers.pages_html(readers.page_elements(blocks, tables)).select("doc_id", F.md5("html").alias("digest"))


@query(r"""
    WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT lang AS book, doc_id AS chapter, sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')))::BIGINT AS words FROM l GROUP BY ALL
""")
def chapter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document as a chapter of its language's book, a verse a line."""
    verses = table(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n", -1)).alias("verse", "line"))
    return rotation.chapter_words(verses.select("book", "chapter", "verse", F.array("line").alias("lines")))


@query("""
    WITH s AS (SELECT max(ts)::VARCHAR AS date, 'k' || user_id AS topic FROM events GROUP BY user_id HAVING user_id % 3 <> 0) SELECT date, topic FROM s ORDER BY date DESC LIMIT 60
""")
def recent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sixty topics, a user each; every third has none."""
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(_s(F.max("ts")).alias("date"))
    return rotation.recent_topics(state.select("date", F.when(F.col("user_id") % 3 != 0, F.concat(L("k"), _s("user_id"))).otherwise("").alias("topic")))


@query("""
    WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) SELECT date::VARCHAR AS date, CASE WHEN day(date) % 2 = 0 THEN 'old' ELSE 'new ' || month(date) END AS topic FROM d
""")
def dates_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of sent dates after all days of orders were sent: what was there stays."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    state = days.where(F.dayofmonth("date") % 2 == 0).select("date", L("old").alias("topic"))
    return digest.recorded(state, days.select("date", F.concat(L("new "), _s(F.month("date"))).alias("topic"))).select(_s("date").alias("date"), "topic")


@query("""
    WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 OR (conv_id % 3 = 0 AND turn = 0) THEN 'h1' ELSE 'p' END AS tag, role || ' ' || turn AS text FROM conversations),
    x AS (SELECT conv_id, turn::DOUBLE AS spot, tag, text, '<' || tag || '>' || text || '</' || tag || '>' AS xhtml FROM b),
    h AS (SELECT conv_id, arg_min(tag, turn) AS first_tag, arg_min(text, turn) AS first_text, min(turn) FILTER (tag = 'h1') AS first FROM b WHERE tag = 'h1' GROUP BY conv_id),
    c AS (SELECT DISTINCT b.conv_id, first IS NOT NULL AS leads, CASE WHEN b.conv_id % 2 = 0 THEN 'Given ' || b.conv_id WHEN first IS NOT NULL THEN first_text ELSE 'the file ' || b.conv_id END AS title, first FROM b LEFT JOIN h USING (conv_id)),
    w AS (SELECT * FROM x UNION ALL SELECT conv_id, -2, 'h1', title, '<h1>' || title || '</h1>' FROM c WHERE NOT leads UNION ALL SELECT conv_id, CASE WHEN leads THEN first + 0.5 ELSE -1 END, 'p', 'Sub & more', '<p class="subtitle">Sub &amp; more</p>' FROM c WHERE conv_id % 5 = 0),
    n AS (SELECT *, sum((tag = 'h1')::INT) OVER (PARTITION BY conv_id ORDER BY spot) AS n FROM w),
    g AS (SELECT conv_id, n, max(text) FILTER (tag = 'h1') AS head, string_agg(xhtml, chr(10) ORDER BY spot) AS xhtml FROM n GROUP BY ALL)
    SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY n)::INTEGER AS chapter, coalesce(head, title) AS title, md5(g.xhtml) AS digest FROM g JOIN c USING (conv_id)
""")
def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: their title, the heading put in where none leads, a subtitle, and the chapters from each heading on."""
    turns = table(spark, sf_dir, "conversations")
    tag = F.when((F.col("turn") % 4 == 2) | ((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0)), "h1").otherwise("p")
    said = F.concat("role", L(" "), _s("turn"))
    found = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), tag.alias("tag"), said.alias("text"), F.concat(L("<"), tag, L(">"), escaped(said), L("</"), tag, L(">")).alias("xhtml"))
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(L("Given "), _s("doc_id"))).alias("title"), F.concat(L("the_file_"), _s("doc_id")).alias("stem"))
    titles = xhtml.titled(found, raw)
    whole = xhtml.with_heading(found, titles, docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "Sub & more").alias("subtitle")))
    return xhtml.chapters(whole, titles).select("doc_id", "chapter", "title", F.md5("xhtml").alias("digest"))
