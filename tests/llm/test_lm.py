import math
import random
import re
import zlib
from collections import Counter

from inkwell.llm.lm import scored


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def test_base_equals_brute_force_and_the_model_beats_it(spark):
    rng = random.Random(6)
    tongues = [[f"{a}{b}" for b in ("an", "er", "il", "os") for a in letters] for letters in ("bcdf", "ghjk", "lmnp")]
    rows = [(k, " ".join(rng.choice(tongues[k % 3]) for _ in range(rng.randint(1, 300)))) for k in range(400)]
    rows += [(900, None), (901, ""), (901, ""), (None, "Ünder \x0b x\x1cy"), (902, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or -1, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w := words(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w), 6)) for i, t in rows)
    found = scored(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    new = [r for r in found if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_table(spark):
    assert scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_equal_brute_force_and_the_model_sums_to_one(spark, monkeypatch):
    """The score of a text is the sum of the logs of its three factors, each worked out token by token from the trained weights."""
    import numpy as np
    from inkwell.llm import lm

    kept = {}
    real = lm.trained
    monkeypatch.setattr(lm, "trained", lambda made, model, parts: kept.setdefault("model", real(made, model, parts)))
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["the", "of", "an", "xan", "yan", "der", "qu", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    found = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    m = kept["model"]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    vocabulary = sorted({w for _, t in rows for w in words(t)})
    digest = lambda w: np.uint64(lm.xxhash.xxh3_64_intdigest(w.encode()))
    leaf = {w: int(m.leaves(np.array([digest(w)]), np.array([0 if w == "\n" else lm._ending(w.encode())]))[0]) for w in vocabulary}

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    def factors(history):
        """P(class) and, by class, P(leaf): from the rows of the features of the last three words."""
        h = [digest(w) for w in history[::-1][:3]]
        h += [np.uint64(j) for j in range(len(h) + 1, 4)]
        with np.errstate(over="ignore"):
            mixed = [h[0], h[0] * np.uint64(0x9E3779B97F4A7C15) + h[1], h[1], h[2]]
            f = np.array([[(x ^ (x >> np.uint64(29)) ^ np.uint64(t + 1)) * np.uint64(0xBF58476D1CE4E5B9)] for t, x in enumerate(mixed)])
        p = softmax(sum(m.classes[r[0]].astype(float) for r in lm._class_rows(f)) + m.classes[-1])
        inner = []
        for c in range(lm.CLASSES):
            z = sum(m.slots[r[0]].astype(float) for r in lm._leaf_rows(f, np.array([c])))
            z[m.none[c]] = -np.inf
            inner.append(softmax(z))
        return p, inner

    def factor(w):
        return float(lm.word_factors(m, np.array([leaf[w]]), np.array([counts[w]]))[0])

    for i, t in rows[:40]:
        total, w = 0.0, words(t)
        for k, x in enumerate(w):
            p, inner = factors(w[:k])
            c = m.label[leaf[x]]
            total += math.log10(max(p[c] * (inner[c][m.slot[leaf[x]]] if c else 1.0), 1e-30)) + math.log10(factor(x))
            if i < 3:  # over all leaves the model is a distribution
                assert abs(p[0] + sum(p[m.label[j]] * inner[m.label[j]][m.slot[j]] for j in range(1, lm.LEAVES)) - 1) < 1e-6
        assert abs(found[i].score - total) < 1e-3 * max(1, abs(total)), i
    for shared in {leaf[w] for w in vocabulary if leaf[w] < lm.ENDINGS and leaf[w] > 0}:
        known = [w for w in counts if leaf[w] == shared]
        new = float(lm.word_factors(m, np.array([shared]), np.array([0]))[0])
        if known:
            assert abs(sum(map(factor, known)) + new - 1) < 1e-6


def test_a_document_over_the_size_of_a_unit(spark, monkeypatch):
    from inkwell.llm import lm

    monkeypatch.setattr(lm, "HELD", 500)
    rows = [(1, "a b " * 2000), (2, "b c"), (3, ""), (4, "c " * 700)]
    got = {r.doc_id: (r.n_tokens, r.n_known > 0) for r in scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: 4001, 2: 3, 3: 1, 4: 701}
