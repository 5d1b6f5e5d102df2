import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwell.operators import diagrams, digest, feed, guards, hours, html, rotation, series, transcripts
from inkwell.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


PAGE = """<html><head><title>T</title><meta name="author" content="Ann"><meta property="article:published_time" content="2026-02-03T10:00"></head><body><nav>n</nav>
<main><h1>A <b>B</b></h1><script>var x='</p>'</script><div><p>We use cookies here</p></div><p>Text &amp; more<br>x<p>next</p>
<img src="data:x" srcset="/a.png 1x, /b.png 2x, /c.png 2x"><a href="../rel">l</a><a href="#top">t</a></main><footer>f</footer></body></html>"""


def test_article():
    got = html.article(PAGE, "https://e.org/d/p")
    assert (got["title"], got["author"], got["date"]) == ("AB", "Ann", "2026-02-03")
    assert "cookies" not in got["text"] and "Text & more" in got["text"] and "var x" not in got["html"]
    assert 'src="https://e.org/c.png"' in got["html"] and 'href="https://e.org/rel"' in got["html"] and 'href="#top"' in got["html"]
    bare = html.article("<body><header>h</header><p>x</p><time datetime='2025-01-02'></time></body>", "")
    assert (bare["title"], bare["date"], bare["text"]) == (None, "2025-01-02", "x")
    assert html.article(None, None)["text"] == ""


def test_blocks():
    got = [(b["tag"], b["text"]) for b in html.blocks_of("<h1>T</h1>loose<ol start='3'><li>a<ul><li>b</li></ul></li></ol><table><tr><th>x</th></tr><tr><td>1</td></tr></table><pre>c\nd</pre><h5>low</h5>")]
    assert got == [("h1", "T"), ("p", "loose"), ("oli", "3. a"), ("li", "b"), ("th", "x"), ("tr", "1"), ("pre", "c\nd"), ("p", "low")]


def test_srcset():
    assert html.best_source("a 480w, b 800w, c 800w, d") == "c"
    assert html.best_source(" , ") is None


def test_turns_and_chapters(spark):
    rows = [(1, k, tag, t) for k, (tag, t) in enumerate([("p", "answer"), ("p", "x"), ("h2", "Prompt:"), ("p", "q"), ("p", "Response"), ("p", "y"), ("h1", "Next"), ("p", "z"), ("li", "question")])]
    blocks = spark.createDataFrame(rows, "doc_id int, pos int, tag string, text string")
    assert [(r.label, r.members) for r in transcripts.turns(blocks).orderBy("turn").collect()] == [("Answer", 1), ("Question 1", 1), ("Answer 1", 1)]
    assert [(r.title, r.blocks) for r in transcripts.chapters(blocks, "Start").orderBy("chapter").collect()] == [("Start", 6), ("Next", 3)]


@pytest.mark.parametrize("n", [12, 15, 50, 193])
def test_rotation_properties(spark, n):
    items = spark.range(n).select(F.lit("c").alias("category"), F.col("id").alias("item"))
    cycles = spark.range(40).select(F.lit("c").alias("category"), F.col("id").alias("cycle"))
    order = {}
    for r in rotation.cycle_orders(items, cycles).orderBy("cycle", "pos").collect():
        order.setdefault(r.cycle, []).append(r.item)
    gap = min(3, n // 3)
    for c in range(40):
        assert sorted(order[c]) == list(range(n))
        if c:
            assert order[c] != order[c - 1]
            seen = order[c - 1][-gap:] + order[c][:gap]
            assert all(seen[i] not in seen[max(0, i - gap) : i] for i in range(len(seen)))


def test_easter_and_dates(spark):
    assert [str(one(spark, rotation.easter(F.lit(y)))) for y in (2024, 2025, 2026, 2027, 2038)] == ["2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28", "2038-04-25"]
    assert one(spark, rotation.ordinal_date(F.lit("2026-10-13").cast("date"))) == "Today is Tuesday 13th October 2026."
    assert one(spark, rotation.ordinal_date(F.lit("2026-10-22").cast("date"))) == "Today is Thursday 22nd October 2026."


def test_stewards(spark):
    days = rotation.dates(spark, "2026-03-01", "2026-03-29")
    duty = spark.sql("SELECT * FROM VALUES (DATE'2026-03-01', 'Red', NULL), (DATE'2026-03-15', NULL, 'Fair'), (DATE'2026-03-22', 'Blue', NULL) AS t(date, team, note)")
    teams = spark.createDataFrame([("Red", "Ann, Ben"), ("Blue", "Cy")], "team string, names string")
    got = {str(r.date): r for r in rotation.stewards(days, duty, teams, "Red").collect()}
    assert got["2026-03-01"].mine and got["2026-03-01"].reminder is None
    assert got["2026-03-08"].missing and got["2026-03-08"].reminder
    assert got["2026-03-15"].note == "Fair" and got["2026-03-22"].names == "Cy"
    assert "ended on Sunday 22 March 2026" in got["2026-03-29"].missing


def test_formats(spark):
    L = lambda x: F.lit(float(x))
    said = lambda *columns: list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())
    f = lambda x, fmt: series.format_value(L(x), F.lit(fmt))
    assert said(f(0.25, "pct"), f(1.5e12, "usd"), f(2e6, "number"), f(999.5, "number"), f(1234.56, "dec"), f(0.12345, "index"), f(0.5, "area")) == ["0.2%", "$1.5 trillion", "2 million", "1,000", "1,234.6", "0.123", "0.5 km²"]
    assert said(*(series.compare_to_home(L(x), L(y)) for x, y in ((3, 2), (1, 4), (1, 50), (1, 400)))) == ["1.5× the UK's", "25% of the UK's", "2.0% of the UK's", "0.25% of the UK's"]
    assert said(*(series.land_relation(L(x), L(y)) for x, y in ((2, 2), (1, 1e6), (3, 1), (243.1, 243610)))) == ["the same size as the UK", "99.9999% smaller than the UK", "200% larger than the UK", "99.9% smaller than the UK"]
    assert said(series.gap(L(5.04), L(5.0), F.lit("pct")), series.gap(L(5.16), L(5.0), F.lit("pct")), series.gap(L(3), L(2), F.lit("usd"))) == ["the same as the UK's", "0.2 percentage points higher than the UK's", "1.5× the UK's"]


def test_texts_of_numbers_equal_exact_rounding(spark):
    """Against decimal arithmetic on the exact binary values, half to even; zeros, ties, borders of the scales, tiny and negative values."""
    import random
    from decimal import ROUND_HALF_EVEN, Decimal

    rng = random.Random(8)
    values = [0.0, 0.5, 1.5, 2.5, 0.25, 0.35, 0.125, 999.5, 999999.5, 1e6, 999999.999, 1e9, 1e12, 2.675, 99.95, 99.995, 100.0, 0.1, 0.001, 9.9e-5, 1e-7, 12.345, 9.995, 0.0995, 0.995]
    values += [x * s for x in (rng.random() * 10.0 ** rng.randrange(-5, 13) for _ in range(400)) for s in (1, -1)]

    def places(x, digits, grouped=True):
        return format(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN), ",f" if grouped else "f")

    def scaled(x):
        power = next((p for p in (12, 9, 6) if abs(x) >= 10.0**p), None)
        if power is None:
            return places(x, 0)
        text = places(x / 10.0**power, 2, False)
        return text.rstrip("0").rstrip(".") + {12: " trillion", 9: " billion", 6: " million"}[power]

    want = {x: (places(x, 1, False) + "%", places(x, 1), places(x, 3, False), scaled(x), (places(x, 0) if x >= 100 else f"{x:.3g}") + " km²") for x in values}
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r.x: tuple(r)[1:] for r in rows.select("x", *(series.format_value(F.col("x"), F.lit(k)).alias(k) for k in ("pct", "dec", "index", "number", "area"))).collect()}
    for x in values:
        assert got[x] == tuple(t if t.strip("-0.,%") or x >= 0 else t for t in want[x]), (x, got[x], want[x])
    few = spark.createDataFrame([(None, "pct"), (float("nan"), "usd"), (1.0, "year")], "x double, f string")
    assert [r[0] for r in few.select(series.format_value(F.col("x"), F.col("f"))).collect()] == [None, None, "1"]
    zero = spark.range(1).select(series.compare_to_home(F.lit(1.0), F.lit(0.0)), series.land_relation(F.lit(1.0), F.lit(0.0)), series.gap(F.lit(None).cast("double"), F.lit(1.0), F.lit("pct")))
    assert list(zero.first()) == [None, None, None]


def test_series(spark):
    rows = spark.createDataFrame([("f", "GBR", 2020, 1.0), ("f", "GBR", 2022, 2.0), ("f", "JAM", 2020, 3.0), ("g", "GBR", 2021, 4.0)], "fact string, entity string, year int, value double")
    got = sorted((r.fact, r.entity, r.year, r.value) for r in series.observations(rows, ["fact"], 2, 2024).collect())
    assert got == [("f", "GBR", 2020, 1.0), ("f", "JAM", 2020, 3.0), ("g", "GBR", 2021, 4.0)]
    v = series.versus(rows, ["fact"], "GBR", "JAM", 2024).first()
    assert (v.year, v.home, v.other, list(v.warnings)) == (2020, 1.0, 3.0, ["older common year", "stale"])
    with pytest.raises(Exception, match="ambiguous"):
        series.unambiguous(rows.union(rows), ["fact"]).collect()


def test_clock_change_days(spark):
    days = spark.sql("SELECT explode(array(DATE'2026-03-29', DATE'2026-10-25', DATE'2026-06-01')) AS date")
    labels = days.select(F.explode(F.sequence(hours.day_start(F.col("date")) + F.expr("interval 1 hour"), hours.day_end(F.col("date")), F.expr("interval 1 hour"))).alias("t")).select("t", F.lit(60.0).alias("chance"), F.lit(0.0).alias("mm"))
    got = {str(r.date): (r.expected, r.complete) for r in hours.coverage(labels, days).collect()}
    assert got == {"2026-03-29": (23, True), "2026-10-25": (25, True), "2026-06-01": (24, True)}
    assert not hours.coverage(labels.where("hour(t) <> 5"), days).where("complete").count()


def test_wet_spells(spark):
    at = lambda h: dt.datetime(2026, 1, 5, h)
    rows = [(at(6), 60.0, 0.0, 61), (at(7), 10.0, 0.2, 80), (at(8), 10.0, 0.0, 3), (at(9), 80.0, 5.0, 95)]
    got = [(r.kind, r.intensity, r.likely, r.peak_chance, r.parts) for r in hours.wet_spells(spark.createDataFrame([(1, *r) for r in rows], "p int, t timestamp, chance double, mm double, code int"), ["p"]).orderBy("start").collect()]
    assert got == [("showers", "light", False, 60, ["early morning", "morning"]), ("thunderstorms", "heavy", True, 80, ["morning"])]
    assert one(spark, hours.clock(F.lit("2026-07-01 14:05:00").cast("timestamp"))) == "15:05 (3:05pm)"
    assert one(spark, hours.clock(F.lit("2026-01-01 12:00:00").cast("timestamp"))) == "12:00 (midday)"
    assert one(spark, hours.whole_degrees(F.lit(12.5))) == "13°C" and one(spark, hours.feel(F.lit(11.5))) == "cool"


def test_notices(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'Good Service', 'x', NULL), (2, 'Part Closure', ' Closed  today ', array(named_struct('from', TIMESTAMP'2026-06-01 00:00:00', 'to', TIMESTAMP'2026-06-02 00:00:00'))),
        (3, 'Closure', 'Closed today', NULL), (4, 'Closure', 'Past', array(named_struct('from', TIMESTAMP'2026-05-01 00:00:00', 'to', TIMESTAMP'2026-05-31 23:00:00'))) AS t(seq, severity, reason, periods)""")
    assert [(r.seq, r.reason) for r in hours.notices(rows, F.lit("2026-06-01").cast("date")).collect()] == [(2, "Closed  today")]


def test_feed(spark):
    assert tuple(one(spark, feed.names(F.lit("NEW!  1 John 5. Day 198 - Read")))) == ("item-day-198-1-john-5", "1 John 5 — Day 198")
    assert tuple(one(spark, feed.names(F.lit("Revelation 22 - Day 1260 - The End")))) == ("item-day-1260-revelation-22", "Revelation 22 — Day 1260")
    assert one(spark, feed.is_title_line(F.lit("1 JOHN 5 - Day 198 now"), F.lit("1 John 5. Day 198 - Read")))
    got = feed.clean_notes("<p>1 John 5. Day 198</p><p>Episode Notes:</p><p>In Today's Episode</p><ul><li>a</li><li>Contact us x</li></ul><p>“This is it” — 1 John 5:11</p><p>Today's Scripture: x Podcast Homepage: y</p>", "1 John 5. Day 198 - Read")
    assert [(b["tag"], b["text"]) for b in got] == [("h2", "In Today's Episode"), ("li", "a"), ("blockquote", "“This is it” — 1 John 5:11"), ("p", "Today's Scripture: x")]
    items = spark.createDataFrame([(str(k), dt.datetime(2026, 1, 1 + k // 2), -k) for k in range(4)], "guid string, pub_date timestamp, feed_pos int")
    state = spark.createDataFrame([("0", "sent", dt.datetime(2026, 1, 1))], "guid string, how string, at timestamp")
    assert tuple(feed.next_delivery(items, state).first()) == (0, 3, "1")
    assert tuple(feed.next_delivery(items, state, 2).first()) == (4, 3, None)
    assert feed.next_delivery(items.limit(0), state).first().status == 10


def test_guards(spark):
    check = lambda t: one(spark, guards.violations(F.lit(t), 5))
    assert check("fine text") == [] and check("see www.x.org") == ["url"] and check("<b>x") == ["markup"] and check("a b c d e f") == ["length"] and check("me@x.org") == ["link"]
    assert one(spark, guards.numbers(F.lit("From 2019-2026, -5 or 1,200.5 and 2 Million"))) == ["-5", "1200.5", "2 million", "2019", "2026"]
    assert one(spark, guards.quantities(F.lit("20°C, 3 per cent in 2020"))) == ["2020|", "20|°c", "3|%"]
    assert one(spark, guards.unsupplied(F.lit("20 knots"), F.lit("20°C"))) == ["20|"]
    assert one(spark, guards.parsed_output(F.lit('{"a": "x", "b": 1}'), {"a": 5})).error == "unknown field"
    assert one(spark, guards.parsed_output(F.lit('{"a": "x"}'), {"a": 5})).value.a == "x"
    assert one(spark, guards.parsed_output(F.lit("nonsense"), {"a": 5})).error == "not an object"
    assert one(spark, guards.safe_notice(F.lit("Closed today\r\nUse buses"))) and not one(spark, guards.safe_notice(F.lit("x\n- y")))


BLOCK = "SKY: grey\nHIGH: 20°C\nLOW: 12°C\npeak chance 80%"


@pytest.mark.parametrize(
    ("said", "day", "faults"),
    [
        ("Grey with rain likely this afternoon. A high of 20°C.", (True, False, False, True), []),
        ("Grey and cold. A high of 20°C.", (True, False, False, True), ["no rain"]),
        ("Dry all day with showers. Up to 20°C.", (True, False, False, True), ["dry day"]),
        ("Rain later. No rain expected this morning; a high of 20°C.", (True, False, False, True), []),
        ("Showers about. It won’t rain. Highs of 20°C.", (True, False, False, True), ["denial"]),
        ("Rain this morning. A high of 20°C.", (True, True, True, True), ["heavy", "thunder"]),
        ("Heavy thunderstorms. A high of 20°C.", (True, True, True, True), []),
        ("Rain in the morning. A high of 20°C.", (True, False, False, False), ["certain"]),
        ("Possibly rain in the morning. A high of 20°C.", (True, False, False, False), []),
        ("Sunny. A high of 20°C.", (False, False, False, False), ["not dry"]),
        ("Dry. Rain at noon. A high of 20°C.", (False, False, False, False), ["rain"]),
        ("Dry with a low of 20°C.", (False, False, False, False), ["high"]),
        ("Dry, a high of 20°C and 30 mm.", (False, False, False, False), ["quantity"]),
        ("A low of 12°C, a high of 20°C, and rain is unlikely.", (False, False, False, False), []),
    ],
)
def test_weather_faults(spark, said, day, faults):
    assert one(spark, guards.weather_faults(F.lit(said), F.lit("20°C"), F.lit(BLOCK), *map(F.lit, day))) == faults


def test_comparison_and_fact_faults(spark):
    block, years = F.lit("A 5 (2020)\nB 4 (2019)\nRELATION: 1.2× the UK's"), F.array(F.lit(2020), F.lit(2019))
    check = lambda t, r="1.2× the UK's": one(spark, guards.comparison_faults(F.lit(t), F.lit(r), years, block))
    assert check("It is 1.2× The UK’s, more than in 2019 against 2020.") == []
    assert check("It is 1.2× the UK's. In 2019 and 2020.") == ["sentences"] and check("In 2019 and 2020 it is higher.") == ["relation"]
    assert check("1.2× the UK's in 2020") == ["years"] and check("1.2× the UK's, 2019, 2020 and 7") == ["number"] and check("  ", "") == ["empty", "years"]
    fact = lambda t, r: one(spark, guards.fact_faults(F.lit(t), F.lit(r), F.lit(None).cast("array<int>"), block))
    assert fact("It is higher.", "") == ["compares"] and fact("5 because of 4.", "") == ["cause"] and fact("It is 1.2× the UK's, higher.", "1.2× the UK's") == [] and fact("It is 9.", "") == ["quantity"]
    label = lambda t, v: one(spark, guards.labelled(F.lit(t), F.lit(v), guards.HIGH, guards.LOW))
    assert label("a low of 3°c and a high of 13°c", "13°C") and not label("a low of 13°c", "13°C") and not label("a high of 13°C", "3°C")
    assert label("low of 20°C then a high of 20°C", "20°C") and not label("high " + "x" * 50 + " 20°C", "20°C")
    lists = one(spark, guards.parsed_output(F.lit('{"a": ["x", "y"], "b": "z"}'), {"a": 5, "b": 5}, ("a",)))
    assert lists.error is None and lists.value.a == ["x", "y"]
    assert one(spark, guards.parsed_output(F.lit('{"a": 1}'), {"a": 5})).error == "a missing" and one(spark, guards.parsed_output(F.lit('{"a": ["see www.x.org"]}'), {"a": 5}, ("a",))).error == "a unsafe"


def test_diagrams(spark):
    rows = diagrams.flowchart("flowchart TD\n subgraph one [Group]\n A[Start] -->|yes| B{Choice}\n end\n B -- no --> C\n B -. maybe .-> D((x))\n A <--> D\n ???\n style A fill:#fff")
    edges = [(r["src"], r["dst"], r["label"], r["style"], r["bidirectional"]) for r in rows if r["kind"] == "edge"]
    assert edges == [("A", "B", "yes", "solid", False), ("B", "C", "no", "solid", False), ("B", "D", "maybe", "dashed", False), ("A", "D", None, "solid", True)]
    assert [r["src"] for r in rows if r["kind"] == "unparsed"] == ["???"] and rows[0]["src"] == "TB"
    assert [(r["label"], r["dst"]) for r in rows if r["kind"] == "node"] == [("Start", "Group"), ("Choice", "Group"), (None, None), ("x", None)]
    assert len([r for r in diagrams.state_diagram("stateDiagram-v2\n[*] --> A\nA --> [*] : done") if r["style"] == "pseudo"]) == 2
    assert [r["style"] for r in diagrams.sequence_diagram("sequenceDiagram\nA->>B: hi\nB-->>A: ho") if r["kind"] == "edge"] == ["solid", "dashed"]
    assert len([r for r in diagrams.git_graph("gitGraph\ncommit\nbranch x\ncommit\ncheckout main\nmerge x") if r["kind"] == "node"]) == 3
    lone = diagrams.git_graph('gitGraph\ncommit tag: "v1"\nbranch dev\ncheckout main\ncommit id: "two"\nmerge dev\nbranch dev\ncommit\nbranch dev\ncommit')
    assert [(r["src"], r["dst"], r["label"]) for r in lone if r["kind"] == "node"] == [("c0", "main", None), ("c1", "main", "two"), ("c2", "dev", None), ("c3", "dev", None)]
    assert [(r["src"], r["dst"]) for r in lone if r["kind"] == "edge"] == [("c0", "c1"), ("c0", "c2"), ("c2", "c3")]
    assert diagrams.flowchart("pie") is None
    graph = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (2, "a", "b"), (2, "b", "a"), *[(3, "r", str(k)) for k in range(5)]], "graph_id int, src string, dst string")
    assert {r.graph_id: r.depth for r in diagrams.depths(graph).collect()} == {1: 3, 2: None, 3: 2}
    assert {r.graph_id: r.depth for r in diagrams._relaxed(graph.distinct(), "graph_id").collect()} == {1: 3, 2: None, 3: 2}
    kinds = spark.createDataFrame([(1, "TB"), (2, "TB"), (3, "BT")], "graph_id int, direction string")
    assert {r.graph_id: r.direction for r in diagrams.directions(kinds, graph).collect()} == {1: "TB", 2: "TB", 3: "RL"}
    assert one(spark, diagrams.is_flow_diagram(F.lit("a --> b\n  |\nc"))) and not one(spark, diagrams.is_flow_diagram(F.lit("same → input")))
    fences = spark.createDataFrame([(1, 3, "", "\n".join(["+--+", "|"] * 4)), (1, 20, "mermaid", "pie"), (1, 30, "python", "a-->b\n" * 9)], "doc_id int, line int, lang string, text string")
    assert sorted(r.line for r in diagrams.problems(fences).collect()) == [3, 20]


def test_digest(spark):
    days = spark.sql("SELECT DATE'2026-01-04' AS date")
    got = digest.gather(days, {"a": spark.sql("SELECT DATE'2026-01-04' AS date, '' AS value, CAST(NULL AS string) AS error"), "b": spark.sql("SELECT DATE'2026-01-04' AS date, CAST(NULL AS string) AS value, 'FetchError 503' AS error")}).first()
    assert (got.a, got.b, got.diagnostics) == ("", None, ["b: FetchError 503"])
    assert one(spark, digest.run_note(F.array().cast("array<string>"), F.array(F.lit("x")))) == "Diagnostics: x"
    state = spark.sql("SELECT DATE'2026-01-04' AS date, 'Old' AS topic")
    assert digest.recorded(state, spark.sql("SELECT DATE'2026-01-04' AS date, 'New' AS topic")).collect()[0].topic == "Old"


FEED = """<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Show</title><itunes:author>Ann</itunes:author><itunes:image href="cover.png"/>
<item><guid>b</guid><title>Two</title><pubDate>Tue, 06 Jan 2026 08:00:00 +0100</pubDate><content:encoded>&lt;p&gt;x&lt;/p&gt;</content:encoded></item>
<item><guid>a</guid><title>One</title><pubDate>Mon, 05 Jan 2026 08:00:00 GMT</pubDate><description>d</description><itunes:image href="own.png"/></item><item><guid> </guid><pubDate>Mon, 05 Jan 2026 08:00:00 GMT</pubDate></item></channel></rss>"""


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    rows = feed.feed_order(readers.feed(spark, str(tmp_path / "f.xml"))).orderBy("seq").collect()
    assert [(r.guid, r.content_html, r.image_url, r.author) for r in rows] == [("a", "d", "own.png", "Ann"), ("b", "<p>x</p>", "cover.png", "Ann")]
    assert rows[1].pub_date == dt.datetime(2026, 1, 6, 7)
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "A_b.MD").write_text("# é")
    (docs / "p.png").write_bytes(bytes.fromhex("89504e470d0a1a0a00"))
    got = {r.stem: (r.format, r.text) for r in readers.files(spark, str(docs)).collect()}
    assert got == {"A_b": ("md", "# é"), "p": ("image", None)}
    assert readers.files(spark, str(docs)).where(readers.is_png(F.col("content"))).count() == 1
    (docs / "x.xyz").write_text("x")
    with pytest.raises(Exception, match="unsupported"):
        readers.files(spark, str(docs)).select("format").collect()
    bank = spark.createDataFrame([('[{"page":1}, [{"indicator":{"id":"P"},"countryiso3code":"GBR","date":"2020","value":"1.5"},{"indicator":{"id":"P"},"countryiso3code":"JAM","date":"2020","value":null}]]',)], "json string")
    assert [tuple(r) for r in readers.world_bank(bank, ["GBR", "JAM"]).collect()] == [("P", "GBR", 2020, 1.5)]
    fund = spark.createDataFrame([('{"values":{"C":{"GBR":{"2020":1.0,"2030":2.0}}}}',)], "json string")
    assert [tuple(r) for r in readers.imf(fund, 2025).collect()] == [("C", "GBR", 2020, 1.0)]
    health = spark.createDataFrame([('{"value":[{"SpatialDim":"GBR","TimeDim":2020,"NumericValue":1.0},{"SpatialDim":"GBR","TimeDim":2021,"NumericValue":null}]}',)], "json string")
    assert [tuple(r) for r in readers.who(health, 2025).collect()] == [("GBR", 2020, 1.0)]
    hour = spark.createDataFrame([('{"utc_offset_seconds":3600,"hourly":{"time":["2026-06-01T01:00"],"precipitation_probability":[5],"precipitation":[0.1],"weather_code":[3]}}',)], "json string")
    assert tuple(readers.hourly(hour).first()) == (dt.datetime(2026, 6, 1), 5.0, 0.1, 3)
    path = str(tmp_path / "state")
    assert readers.state(spark, path, "guid string").count() == 0
    sinks.write_state(spark.createDataFrame([("a",)], "guid string"), path)
    sinks.write_state(spark.createDataFrame([("a",), ("b",)], "guid string"), path)
    assert readers.state(spark, path, "guid string").count() == 2
    book = sinks.epubs(spark.createDataFrame([(1, "T", "A")], "doc_id int, title string, author string"), spark.createDataFrame([(1, 1, "One", "<p>x</p>"), (1, 2, "Two", "<p>y</p>")], "doc_id int, chapter int, title string, xhtml string")).first().epub
    import io
    import zipfile

    names = zipfile.ZipFile(io.BytesIO(bytes(book))).namelist()
    assert names[0] == "mimetype" and "OEBPS/chap_02.xhtml" in names
    assert sinks.column_widths([10, 90], [5, 5], 100) == [17, 83]
    assert one(spark, sinks.should_send(F.lit(None).cast("boolean"), F.lit("epub"))) and not one(spark, sinks.should_send(F.lit(True), F.lit("pdf")))


def test_spans(spark):
    spans = spark.createDataFrame([(1, 1, 1, "Head", 18.0, True), (1, 2, 1, "a", 10.0, False), (1, 2, 2, "b", 10.0, False), (1, 3, 1, "bold", 10.0, True)], "doc_id int, block int, pos int, text string, size double, bold boolean")
    assert [(r.text, r.level) for r in readers.spans_to_blocks(spans).orderBy("block").collect()] == [("Head", 1), ("a b", None), ("bold", 3)]
    box = "doc_id int, page int, {} int, x0 double, y0 double, x1 double, y1 double"
    found = readers.table_of_block(spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 10.0, 10.0)], box.format("block")), spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 10.0, 6.0), (1, 1, 1, 0.0, 0.0, 10.0, 5.0)], box.format("table")))
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2)]


def test_stream_delivers_once(spark, tmp_path):
    from inkwell.sources import commits
    from inkwell.streaming.feed import STATE, deliver

    source, state, sent = str(tmp_path / "in"), str(tmp_path / "state"), []
    rows = [(str(k), dt.datetime(2026, 1, 3 - k)) for k in range(3)]
    spark.createDataFrame(rows, "guid string, pub_date timestamp").coalesce(1).write.parquet(source)
    run = lambda check, **kw: deliver(spark.readStream.schema("guid string, pub_date timestamp").parquet(source), state, str(tmp_path / check), lambda df: sent.extend(r.guid for r in df.collect()), **kw)
    run("c1").awaitTermination()
    assert sent == ["2", "1", "0"]
    run("c2").awaitTermination()  # from the start again: the state knows them all
    assert sent == ["2", "1", "0"] and commits.rows(spark, state, ["guid"], STATE).count() == 3
    spark.createDataFrame([("9", dt.datetime(2026, 2, 1)), ("8", dt.datetime(2026, 2, 1))], "guid string, pub_date timestamp").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="exceed"):
        run("c3", max_sends=1).awaitTermination()
    assert len(sent) == 3


def test_state_survives_a_crash_between_its_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    sinks.write_state(spark.createDataFrame([("a",)], "guid string"), path)
    # a version whose pointer was never put down is not read
    spark.createDataFrame([("x",)], "guid string").write.parquet(f"{path}/version=2")
    assert [r.guid for r in readers.state(spark, path, "guid string").collect()] == ["a"]
    for k in range(3):
        sinks.write_state(spark.createDataFrame([(str(k),)], "guid string"), path)
    assert [r.guid for r in readers.state(spark, path, "guid string").collect()] == ["2"]
    assert len(readers.state_versions(spark, path)) == 2


def test_pages_without_html_and_large_ones_stay(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>A</h1>"), (2, "u", None), (3, "u", "<p>" + "x " * 11_000_000 + "</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.n) for r in html.articles(pages).select("page_id", "title", F.length("text").alias("n")).collect()}
    assert got == {1: ("A", 1), 2: (None, 0), 3: (None, 21_999_999)}


def test_texts_are_written_to_few_folders(spark, tmp_path):
    path = str(tmp_path / "texts")
    sinks.write_texts(spark.createDataFrame([(f"s{k}", f"line\n{k}") for k in range(50)], "slug string, text string"), path, 8)
    assert sinks.read_text(spark, path, "s7", 8) == "line\n7" and sinks.read_text(spark, path, "none", 8) is None
    assert len([p for p in (tmp_path / "texts").iterdir() if p.name.startswith("part=")]) <= 8


def test_hot_hosts(spark):
    from inkwell.functions import urls

    rows = [(f"https://hot.gov.uk/{k}",) for k in range(3000)] + [("https://x.org/1",), ("https://a.gov.uk/",)]
    domains = spark.createDataFrame([("gov.uk", "Government")], "domain string, publisher string")
    got = {r.publisher: r.n for r in urls.publishers(spark.createDataFrame(rows, "url string"), domains).groupBy("publisher").agg(F.count("*").alias("n")).collect()}
    assert got == {"Government": 3001, "x.org": 1}
