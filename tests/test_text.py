import random

import pytest
from pyspark.sql import functions as F

import brute
from inkwell.functions import folds, latex, text, urls

FENCE = "```\n1) a\n#tag\n- x\n```"


def apply(spark, rule, value):
    return spark.createDataFrame([(value,)], "t string").select(rule(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        (text.hashtags, "#Tag #Other", "\\#Tag #Other"),
        (text.hashtags, "## Heading", "## Heading"),
        (text.hashtags, FENCE, FENCE),
        (text.paren_lists, "intro:\n1) a\n2\\) b", "intro:\n1. a\n2. b"),
        (text.paren_lists, "see\n1) alone\nin prose", "see\n1) alone\nin prose"),
        (text.paren_lists, "\n1) a", "\n1. a"),
        (text.metadata_breaks, "**A:** x\n**B:** y\nz", "**A:** x  \n**B:** y\nz"),
        (text.metadata_breaks, "**A:** x  \n**B:** y", "**A:** x  \n**B:** y"),
        (text.blank_before_blocks, "Foo:\n- a\n- b\n| t |", "Foo:\n\n- a\n- b\n| t |"),
        (text.blank_before_blocks, "- a", "- a"),
        (text.export_timestamps, "**Created:** 8/31/2026 9:44:08", "**Created:** 2026-08-31 09:44:08"),
        (text.export_timestamps, "**Updated:** 2026/8/1 09:44:08 ", "**Updated:** 2026-08-01 09:44:08 "),
        (text.export_timestamps, "**Created:** 2/30/2026 9:44:08", "**Created:** 2/30/2026 9:44:08"),
        (text.export_timestamps, "**Created:** 2/3/2026 24:00:00", "**Created:** 2/3/2026 24:00:00"),
        (text.front_matter, "---\na: 1\nb: 2\n---\nText", "a: 1  \nb: 2\nText"),
        (text.front_matter, "x\n---\na\n---\n", "x\n---\na\n---\n"),
        (text.zero_width_fences, "`​`​`mermaid\na​b", "```mermaid\na​b"),
        (text.zero_width_fences, "`​~​`x", "`​~​`x"),
        (text.safe_symbols, "✅Done ⚠️ 🔥! ⬇️", "[Yes] Done [Warning] [Hot]! v"),
        (folds.nested_lists, "* a\n    * b\n        * c\n* d", "* a\n  * b\n    * c\n* d"),
        (folds.nested_lists, "* a\n  * b", "* a\n  * b"),
        (text.spaced_fences, "text\n```\ncode\n```\nmore", "text\n\n```\ncode\n```\n\nmore"),
        (text.spaced_fences, "> text\n> ```\n> x\n> ```\n> - a", "> text\n>\n> ```\n> x\n> ```\n>\n> - a"),
        (text.spaced_fences, "- a\n  ```\n  x\n  ```\n- b", "- a\n  ```\n  x\n  ```\n- b"),
        (text.promoted_labels, "- **RAG** - uses an index", "- **RAG**\n  - uses an index"),
        (text.promoted_labels, "- plain - text", "- plain - text"),
        (text.promoted_labels, "1. **A:** – b", "1. **A:**\n  - b"),
        (text.clean_text, "See [x](http://y) now  , ok .", "See now, ok."),
        (text.paragraphs, " a \n\n\n b\n \n", "a\n\nb"),
    ],
)
def test_vectors(spark, rule, before, after):
    assert apply(spark, rule, before) == after


def test_null_and_empty_texts(spark):
    for rule in (*text.NORMALISERS, text.safe_symbols, folds.nested_lists, text.spaced_fences, text.promoted_labels):
        assert apply(spark, rule, None) is None
        assert apply(spark, rule, "") == ""


def test_normalisers_are_idempotent(spark):
    source = "Foo:\n1) a\n2) b\n#tag\n**A:** x\n**B:** y\n- l\n```\n#c\n```\n"
    for rule in (text.hashtags, text.paren_lists, text.metadata_breaks, text.blank_before_blocks, text.export_timestamps, text.spaced_fences):
        once = apply(spark, rule, source)
        assert apply(spark, rule, once) == once


def test_math():
    spans = folds.math_spans("cost $5 and $x^2$, $$a_b$$ `$c^2$` \\(d\\)\n[\ny = 1\n===\n]\n")
    assert [(s[2], s[3]) for s in spans] == [("x^2", False), ("a_b", True), ("d", False), ("y = 1\n=", True)]
    out, tokens = folds.protected("a $x^2$ b")
    assert out == f"a {tokens[0][0]} b"
    assert tokens[0][1:] == ("x^2", False)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTPS://Example.COM/A/?utm_source=x&b=1#frag", "https://example.com/A/?b=1"),
        ("https://www.example.com/p/", "https://www.example.com/p/"),
        ("https://example.com/?GCLID=1", "https://example.com/"),
        ("https://example.com/?q=", "https://example.com/?q="),
        ("HTTP://H.org#x", "http://h.org"),
    ],
)
def test_url_keys(spark, url, key):
    assert apply(spark, urls.normalised, url) == key


def test_slugs_and_titles(spark):
    assert apply(spark, text.page_slug, "  A -- b! ") == "a-b"
    assert apply(spark, text.page_slug, "!!") == "page"
    assert apply(spark, lambda t: text.versioned_title(F.lit("Plan"), t), "x_V2") == "Plan (V2)"
    assert apply(spark, text.n_words, " a  b ") == 2
    assert apply(spark, lambda t: text.first_words(t, 2), "a  b c") == "a b"


def test_sources_and_publishers(spark):
    known = spark.createDataFrame([("d", 1, "https://A.org/x?utm_a=1"), ("d", 2, "https://a.org/x")], "day string, seq int, url string")
    chosen = spark.createDataFrame([("d", 1, "https://a.org/x#y", "s"), ("d", 2, "https://a.org/x", "t"), ("d", 3, "https://b.org", "u")], "day string, seq int, url string, supports string")
    assert [tuple(r) for r in urls.validated_sources(chosen, known, ["day"]).collect()] == [("d", 1, "https://A.org/x?utm_a=1", "s")]
    domains = spark.createDataFrame([("gov.uk", "Government"), ("stats.gov.uk", "Statistics")], "domain string, publisher string")
    pages = spark.createDataFrame([("https://www.stats.gov.uk/a",), ("https://notgov.uk",), ("https://x.gov.uk",)], "url string")
    assert {r.url: r.publisher for r in urls.publishers(pages, domains).collect()} == {"https://www.stats.gov.uk/a": "Statistics", "https://notgov.uk": "notgov.uk", "https://x.gov.uk": "Government"}


def test_twenty_thousand_fenced_lines_take_seconds(spark):
    import time

    lines = []
    for k in range(4000):
        lines += ["#tag", "1) item", "**A:** x", "```" if k % 3 == 0 else "text", "- list"]
    source = "\n".join(lines)
    docs = spark.createDataFrame([(source,)], "t string").cache()
    docs.count()
    for rule in (text.hashtags, text.paren_lists, text.metadata_breaks, text.blank_before_blocks, text.export_timestamps):
        began = time.time()
        docs.select(F.length(rule(F.col("t")))).collect()
        assert time.time() - began < 5, rule


def test_mask_of_fences(spark):
    rows = ["a", "```", "b", "```", "c", "  ```x", "d"]
    got = spark.createDataFrame([(rows,), (["a"],), (["```"],), ([""],)], "r array<string>").select(text.fence_mask(F.col("r")).alias("m")).collect()
    assert [r.m for r in got] == [[False, True, True, True, False, True, True], [False], [True], [False]]


def test_line_rules_against_brute_force(spark):
    """Texts of every kind of line in every order, among them fences that other fences stand in."""
    rng = random.Random(7)
    pieces = ["", " ", "text", "```", "```py", "````", "~~~", "~~~ ~", "  ```", " ```", "> ```", "> ~~~~", ">> ```x", "> ", ">", "> a", "- a", "- ", "- ```", "\t```", "1. **A (b** - c", "- **A (b)** – c - d", "* **[x** — y", "+  **L:**   - t", "- **A)(** - c", "  2. **n** -x", "- **a\u00a0** - ", "```  "]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["", "```", "```\n```\n```\nx"]
    many = "\n".join(["x", "```"] * 3500)  # fences that are followed through in several parts
    rows = spark.createDataFrame([(t,) for t in [*texts, many]], "t string").repartition(4)
    for r in rows.select("t", text.spaced_fences(F.col("t")).alias("fences"), text.promoted_labels(F.col("t")).alias("labels")).collect():
        assert r.fences == brute.space_fences(r.t), r.t
        assert r.labels == brute.split_labels(r.t), r.t


def test_mathematics_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["H", "_2", "O", "^{10}", "x", "^", "_", "{", "}", "\\boxed{", " ", "abcdefgh", "_{abcd}", "12", "\\frac", "<", "=", ",", ".5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(4000)]
    texts += ["", "H_2O", "x^{10}", "x_2y^3", "\\frac{1}{2}", "\\boxed{x+{1}}", " \\boxed{x} ", "\\boxed{x} and y", "\\boxed{x}}", "\\boxed{", "\\boxed{x}{y}", "1,000.50", "<^>x^2"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in rows.select("t", latex.scripts(F.col("t")).alias("s"), latex.unboxed(F.col("t")).alias("u"), latex.looks_like_math(F.col("t")).alias("m")).collect():
        if r.t is None:
            assert (r.s, r.u.latex, r.m) == (None, None, None)
        else:
            assert r.s == brute.simple_scripts(r.t), r.t
            assert (r.u.latex, r.u.boxed) == brute.unboxed(r.t), r.t
            assert r.m == folds.looks_like_math(r.t), r.t
