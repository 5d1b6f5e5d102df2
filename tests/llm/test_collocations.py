import random
import re
from collections import Counter, defaultdict

import pytest

from inkwell.llm import collocations as module
from inkwell.llm.collocations import collocations


def _brute(rows, least=10, inside=50, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            lang_ = "und" if lang is None else lang
            n[lang_] += len(w)
            for size in (1, 2, 3):
                f[lang_].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            if any(100 * b >= inside * a and any(h[k : k + len(g)] == g for k in range(len(h) - len(g) + 1)) for h, b in candidates.items() if len(h) > len(g)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.collect())


def _rows():
    rng = random.Random(2)
    words = ["the", "of", "New", "York", "city", "Ünder", "ünder", "a b", "x", "\x00z", "-", "hot"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", "! ?"]) for _ in range(rng.randrange(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(150)]
    return rows + [("en", "hot pair hot pair hot pair")] * 80 + [("fr", None), (None, ""), ("it", " ,;\n"), ("en", "the of " * 3000)]


@pytest.mark.parametrize("bucket", [module.BUCKET, 500])
def test_against_counting_all_phrases(spark, bucket):
    docs = spark.createDataFrame([(lang, 1, "x", text) for lang, text in _rows()], "lang string, a int, phrase string, text string").repartition(5)
    old, module.BUCKET = module.BUCKET, bucket
    try:
        got = collocations(docs)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert _got(got) == _brute(_rows())
    finally:
        module.BUCKET = old


def test_limits_of_ranks_and_containment(spark):
    docs = spark.createDataFrame(_rows(), "lang string, text string")
    assert _got(collocations(docs, 3, 90, 7)) == _brute(_rows(), 3, 90, 7)


def test_small_units_and_hot_parts(spark):
    old, module.UNIT, module.HOT_SHARE = (module.UNIT, module.HOT_SHARE), 200, 30
    try:
        assert _got(collocations(spark.createDataFrame(_rows()[:120], "lang string, text string"), 5)) == _brute(_rows()[:120], 5)
    finally:
        module.UNIT, module.HOT_SHARE = old


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("en", "one word")]):
        assert collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores of counts as large as a trillion, exactly."""
    a, left, right = 999_999_999_989, 1_000_000_000_039, 1_000_000_000_061
    row = spark.sql(f"SELECT {a}L AS a, {left}L AS l, {right}L AS r").select(module.score().alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_filter_loses_no_triple(spark):
    """With a Bloom filter of all ones, and with the real one, the same triples are frequent."""
    docs = spark.createDataFrame(_rows(), "lang string, text string")
    found = module.pieces(docs)
    few = module.ngram_counts(found, 4).where("size = 3").select("lang", "gram", "f")
    brute = {(lang, phrase, a) for lang, _, phrase, a, *_ in _brute(_rows(), 4, 10**9, 10**9) if phrase.count(" ") == 2}
    assert {tuple(r) for r in few.collect()} == brute
