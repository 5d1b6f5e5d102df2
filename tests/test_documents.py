import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.functions.membership import maybe_in
from inkwell.operators import alignment, links, measures
from inkwell.sources import sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_links_of_html(spark):
    page = """<!-- <a href="no1"> --><script src='s.js'>var x = '<a href="no2">';</script><style>a{b:url(no3)}</style>
      <A HREF = "https://a.org/?x=1&amp;y=2" title='href="no4"'>x</a><img alt="a > b" src=pic.png><a href=''>e</a><a data-href="no5" href=' s p '>y</a><p>href="no6"</p><link href="z.css"/><a href="unclosed"""
    assert one(spark, links.html_links(F.lit(page))) == ["s.js", "https://a.org/?x=1&y=2", "pic.png", "", "s p", "z.css"]
    assert one(spark, links.html_links(F.lit(""))) == [] and one(spark, links.html_links(F.lit(None).cast("string"))) is None
    long = "<a href='x'" + " b='1'" * 20_000 + ">" + "<!--" + "y" * 100_000
    assert one(spark, links.html_links(F.lit(long))) == ["x"]


def test_links_of_markdown(spark):
    source = 'see [a](https://a.org/b_(c) "t"), ![i](pic.png) and <http://x.y/z> or https://w.w/q, [b]( <s.html> ).'
    assert one(spark, links.markdown_links(F.lit(source))) == ["https://a.org/b_(c)", "pic.png", "s.html", "http://x.y/z", "https://w.w/q"]


def test_foreign_links_against_sets(spark):
    rng = random.Random(1)
    found = {(rng.randrange(20), f"u{rng.randrange(60)}") for _ in range(400)} | {(99, "u1"), (None, "u1"), (None, "u2")}
    listed = {(rng.randrange(20), f"u{rng.randrange(60)}") for _ in range(400)} | {(None, "u1")}
    schema = "doc int, link string"
    got = links.foreign(spark.createDataFrame(sorted(found, key=str) + [(3, None)], schema), spark.createDataFrame(sorted(listed, key=str) * 2 + [(3, None)], schema), "doc")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(found - listed, key=str)
    few = spark.createDataFrame([(1, "a")], schema)
    assert links.foreign(few, few.limit(0), "doc").count() == 1 and links.foreign(few.limit(0), few, "doc").count() == 0


def test_bloom_filter_tells_most_others(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    got = {(r.inside, r.maybe): r["count"] for r in maybe_in(spark.range(35_000), F.col("id"), keys, "maybe").groupBy((F.col("id") % 7 == 0).alias("inside"), "maybe").count().collect()}
    assert got[True, True] == 5000 and got.get((False, True), 0) < 1500


def test_emoji_become_images_but_in_preformatted_text(spark):
    name = one(spark, text.emoji_asset(F.lit("👍🏽")))
    image = lambda e: f'<img class="emoji-img" src="{one(spark, text.emoji_asset(F.lit(e)))}" alt="{e}"/>'
    assert name.startswith("images/emoji-") and name != one(spark, text.emoji_asset(F.lit("👍")))
    source = "a😀b👍🏽 <PRE class='x'>😀\n🎉</pre>🇬🇧👩‍💻 $1 \\ <pre>open 😀"
    want = f"a{image('😀')}b{image('👍🏽')} <PRE class='x'>😀\n🎉</pre>{image('🇬🇧')}{image('👩‍💻')} $1 \\ <pre>open {image('😀')}"
    assert one(spark, text.with_emoji_images(F.lit(source))) == want
    for plain in ("", "no emoji <pre>x</pre>", "<pre>😀</pre>"):
        assert one(spark, text.with_emoji_images(F.lit(plain))) == plain
    docs = spark.createDataFrame([(2, "🎉 😀 🎉"), (1, "<pre>🇬🇧</pre> 😀"), (3, None), (4, "x")], "doc_id int, text string")
    got = text.emoji_assets(docs, "doc_id", "text").orderBy("number").collect()
    assert [(r.number, r.sequence, r.documents, r.places) for r in got] == [(1, "😀", 2, 2), (2, "🎉", 1, 2)]
    assert len({r.asset for r in got}) == 2


def test_lines_after_a_change(spark):
    cases = {
        1: ("a\nb\nc", "a\n\nb\nc", [1, None, 2, 3]),
        2: ("x\nx\nu\nx", "x\nnew\nx\nu\nx", [1, None, 2, 3, 4]),
        3: ("a\nb  \nc\nd", "a\nb\nC\nd", [1, 2, None, 4]),  # blanks at an end do not count
        4: ("u\nv", "v\nu", [2, 1]),  # no anchor: one gap, in which a line may have moved
        5: ("", "", [1]),
        6: ("```\nk\n```\n```\nm\n```", "\n```\nk\n```\n\n```\nm\n```", [None, 1, 2, 3, None, 4, 5, 6]),
    }
    docs = spark.createDataFrame([(k, s, r) for k, (s, r, _) in cases.items()] + [(9, None, None)], "doc_id int, old string, new string")
    got = {}
    for r in alignment.source_lines(docs, "doc_id", "old", "new").orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.source_line)
    assert got == {k: want for k, (_, _, want) in cases.items()}


def test_random_insertions_are_undone(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        old = [rng.choice([f"line {rng.randrange(30)}", "", "```", "-"]) for _ in range(rng.randrange(1, 60))]
        new = []
        for i, line in enumerate(old, 1):
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                new.append((f"new {rng.randrange(10**9)}", None))
            new.append((line, i))
        rows.append((k, "\n".join(old), "\n".join(x for x, _ in new)))
        want[k] = [n for _, n in new]
    got = {}
    for r in alignment.source_lines(spark.createDataFrame(rows, "doc_id int, old string, new string"), "doc_id", "old", "new").orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.source_line)
    assert got == want


def test_lines_of_blocks(spark):
    lines = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, 2)], "doc_id int, line int, source_line int")
    blocks = spark.createDataFrame([(1, 2, 2, "a"), (1, 2, 1, "b"), (2, 1, 1, "c")], "doc_id int, line int, size int, name string")
    assert {r.name: r.source_line for r in alignment.block_lines(blocks, lines, "doc_id").collect()} == {"a": 2, "b": None, "c": None}


def test_widths_equal_the_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for t in range(60):
        n = rng.randrange(1, 9)
        weight, token = [float(rng.randrange(1, 200)) for _ in range(n)], [rng.uniform(0, 120) for _ in range(n)]
        want[t] = sinks.column_widths(weight, token, 468.0)
        rows += [(t, k, weight[k], token[k] + measures.PADDING) for k in range(n)]
    got = {(r.t, r.c): r.width for r in measures.widths(spark.createDataFrame(rows, "t int, c int, weight double, least double"), ["t"], 468.0).collect()}
    for t, whole in want.items():
        assert [got[t, k] for k in range(len(whole))] == pytest.approx(whole)
    sizes = measures.cell_sizes(spark.createDataFrame([(1, 0, "ab cdef"), (1, 0, None), (1, 1, "")], "t int, c int, x string"), ["t"], "c", "x", 2.0)
    assert sorted(tuple(r) for r in sizes.collect()) == [(1, 0, 7.0, 20.0), (1, 1, 1.0, 12.0)]


@pytest.mark.parametrize("few", [measures.FEW, 3])
def test_medians_of_all_kinds_of_groups(spark, few, monkeypatch):
    """With few distinct values left after one pass, and with several passes."""
    monkeypatch.setattr(measures, "FEW", few)
    import statistics

    rng = random.Random(7)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(500)],
        "odd": [rng.gauss(0, 1e6) for _ in range(501)],
        "skew": [1e-9 * k for k in range(300)] + [1e12],
        "same": [4.0] * 50,
        "two": [1.0, 2.0],
        "one": [-0.5],
        None: [3.0, 1.0, 2.0],
        "wide": [-1.7e308, 1.7e308, 5.0],
        "ties": [1.0] * 40 + [2.0] * 41 + [3.0] * 5,
    }
    rows = [(g, float(x), 1) for g, xs in groups.items() for x in xs] + [("even", None, 1), ("none", None, 1)]
    rng.shuffle(rows)
    got = {r.g: (r.n, r.median) for r in measures.medians(spark.createDataFrame(rows, "g string, x double, n int").select("g", "x"), ["g"], "x").collect()}
    assert got == {g: (len(xs), pytest.approx(statistics.median(xs), abs=1e-15)) for g, xs in groups.items()}
    odd = spark.createDataFrame([("i", float("inf")), ("i", float("-inf")), ("i", 1.0), ("n", float("nan")), ("n", 1.0), ("n", 2.0), ("a", float("inf"))], "g string, x double")
    got = {r.g: r.median for r in measures.medians(odd, ["g"], "x").collect()}
    assert got == {"i": 1.0, "n": 2.0, "a": float("inf")}
    assert measures.medians(odd.limit(0), ["g"], "x").count() == 0
