import random

from inkwell.llm.langid import UNKNOWN, held_out, identified, keep_identified, train
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["eau", "tion", "qu", "é"]}


def corpus(spark, n=240):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        lang = sorted(SYLLABLES)[k % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        rows.append((k, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(spark)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", None), (1003, "The. 99", None), (None, "schung ungei", "bb"), (1004, "Ω Ψ Ж Д Щ Ю 中 文 字 " * 40, "cc"), (1005, "the ing " * 20_000, "aa"), (1005, "the ing " * 20_000, "aa")]
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g in rows + odd], "doc_id long, text string, lang string, score string")
    model = train(docs)
    got = identified(docs, model).collect()
    by = {r.doc_id: r for r in got}
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("h")).collect()}
    new = [i for i, _, _ in rows if flags[i]]
    truth = {i: g for i, _, g in rows}
    assert len(new) > 30 and sum(by[i].lang_pred == truth[i] for i in new) >= 0.98 * len(new)
    assert not any(by[i].rejected for i in truth)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(odd)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == [UNKNOWN] * 3
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert by[1004].rejected and not by[1005].rejected
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in by if not by[i].rejected}


def test_prediction_reads_the_text_alone(spark):
    docs = spark.createDataFrame([(i, t, g) for i, t, g in corpus(spark)], "doc_id long, text string, lang string")
    model = train(docs)
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    one = sorted((r.doc_id, r.lang_pred, r.score) for r in identified(docs, model).collect())
    two = sorted((r.doc_id - 7, r.lang_pred, r.score) for r in identified(other, model).collect())
    assert one == two


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert identified(docs, train(docs)).first().lang_pred == UNKNOWN
    empty = docs.limit(0)
    assert identified(empty, train(empty)).count() == 0


def brute_models(words, order=5, alphabet=5000):
    """P(character | context) of an interpolated Kneser-Ney model over words between borders, from plain dictionaries: a function of (context, character)."""
    from collections import Counter, defaultdict

    raw = [Counter() for _ in range(order + 1)]
    for w, c in words.items():
        s = "\x02" + w + "\x03"
        for n in range(1, order + 1):
            for k in range(1, len(s)):
                if k >= n - 1:
                    raw[n][s[k - n + 1 : k + 1]] += c
    adjusted = [None] * (order + 1)
    for n in range(1, order + 1):
        if n == order:
            adjusted[n] = dict(raw[n])
            continue
        left = defaultdict(set)
        for g in raw[n + 1]:
            left[g[1:]].add(g[0])
        adjusted[n] = {g: len(left[g]) + (raw[n][g] if g[0] == "\x02" else 0) for g in raw[n]}
    discount = [0.0] * (order + 1)
    for n in range(1, order + 1):
        once, twice = (sum(v == x for v in adjusted[n].values()) for x in (1, 2))
        discount[n] = min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.1), 0.95)
    by = [defaultdict(dict) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in adjusted[n].items():
            by[n][g[:-1]][g[-1]] = c

    def p(context, char):
        value = 1 / alphabet
        for n in range(1, order + 1):
            if len(context) < n - 1:
                break
            own = by[n].get(context[len(context) - n + 1 :] if n > 1 else "")
            if own:
                total = sum(own.values())
                value = max(own.get(char, 0) - discount[n], 0) / total + discount[n] * len(own) / total * value
        return value

    return p


def test_word_scores_equal_brute_force_kneser_ney():
    import math
    from collections import Counter

    import numpy as np
    from inkwell.llm.langid import Merged, fit

    rng = random.Random(4)
    samples = [Counter("".join(rng.choice(SYLLABLES[g]) for _ in range(rng.randint(1, 4))) for _ in range(300)) for g in ("aa", "bb")]
    merged = Merged(["aa", "bb"], [fit(c) for c in samples])
    tests = ["the", "theing", "zzz", "qu", "schung", "é", "onononon", "t"]
    got = merged.scores(tests)
    for j, words in enumerate(samples):
        p = brute_models(words)
        for k, w in enumerate(tests):
            s = "\x02" + w + "\x03"
            want = sum(math.log(p(s[:i], s[i])) for i in range(1, len(s)))
            assert np.isclose(got[k, j], want, rtol=1e-4), (w, j)
            assert got[k, -1] == len(w) + 1


def test_gibberish_and_an_unlearned_language_are_rejected(spark):
    rng = random.Random(3)
    rows = corpus(spark, 300)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(80)) for _ in range(20)]
    other = [" ".join("".join(rng.choice(["wysz", "kow", "dzi", "przy", "nik"]) for _ in range(rng.randint(1, 4))) for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame(rows + [(5000 + k, t, None) for k, t in enumerate(junk + other)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in identified(docs, train(docs)).collect()}
    assert all(got[5000 + k] for k in range(40))
    assert not any(got[i] for i, _, _ in rows)


def test_ties_go_to_the_language_of_the_smaller_name(spark):
    rows = [(k, "same words here", "bb" if k % 2 else "aa") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identified(docs, train(docs)).collect()} == {"aa"}
