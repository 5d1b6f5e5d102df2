import random
import re

import pytest

from inkwell.llm import neardup


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Classes by plain Jaccard similarity over all pairs."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    text = dict(rows)
    for i in root:
        for j in root:
            if i < j and ((text[i] or "") == (text[j] or "") or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_shingles_equal_plain_ones():
    texts = ["", "One two", "a b c d e", "a b c d e f a b c d e", "É, x-y 9\n!", "..."]
    found = neardup.Shingled(texts)
    assert [len(found.of(k, found.hashes)) for k in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert neardup.Shingled(["A b, c"]).keys == neardup.Shingled(["a B c"]).keys
    assert found.of(3, found.tf).sum() == 7


@pytest.mark.parametrize("block", [250, 8])
def test_classes_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))) for _ in range(40)]
    texts = list(base)
    for t in base[:20]:
        texts += [edited(rng, t, 1), edited(rng, t, 2), t.upper() + "!"]
    texts += [edited(rng, base[0], rng.randint(0, 2)) for _ in range(80)]  # a hot group of near copies
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(40)]
    texts += [None, "", "!!!", "!!!", "???", "one two", "One, two.", "w " * 30_000]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", b"") for i, t in rows], "doc_id long, text string, id string, key binary")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    want = brute(rows)
    assert got == want
    kept = {r.doc_id for r in neardup.drop_near_copies(docs).collect()}
    assert kept == set(want.values())


def test_empty_table_and_null_ids(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in neardup.classes(docs).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_isolated_pairs_of_plain_similarity(spark):
    """Pairs that only the plain clause links: their weighted similarity is far below 0.8, so weighted samples alone miss most of them."""
    rng = random.Random(11)
    new = lambda n: " ".join(f"n{rng.randrange(10**9)}" for _ in range(n))
    texts = []
    for _ in range(60):  # the same shingles, a line repeated 50 and 150 times
        line, rest = new(20), new(104)
        texts += [" ".join([line] * n + [rest]) for n in (50, 150)]
    for k in range(30):  # shared shingles that 60 further texts hold, own ones that are rare: 96 of 116
        passage = " ".join(f"f{k}x{j}" for j in range(100))
        texts += [f"{passage} {new(10)}", f"{passage} {new(10)}"]
        texts += [f"{passage} {new(400)}" for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(2 * k, 2 * k + 1) for k in range(60)] + [(120 + 62 * k, 121 + 62 * k) for k in range(30)]
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in pairs)
    assert [(i, j) for i, j in pairs if got[i] != got[j]] == []
    assert len(set(got.values())) == len(texts) - len(pairs)


def weighted(rows):
    """Per text its shingles with tf x idf, idf by exact document frequencies over all rows."""
    import math
    from collections import Counter

    counted = {}
    for i, t in rows:
        w = words(t)
        counted[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for c in counted.values() for s in c)
    n = len(rows)

    def idf(s):
        if df[s] < max(2.0, neardup.SHARE * n):
            return 1.0
        return neardup.FLOOR + (1 - neardup.FLOOR) * min(1, max(0, math.log(max(df[s] / n, neardup.SHARE)) / math.log(neardup.SHARE)))

    return {i: {s: c * idf(s) for s, c in x.items()} for i, x in counted.items()}


def weighted_jaccard(a, b):
    both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_both(rows):
    """Classes where the weighted or the plain Jaccard similarity is 0.8 or more, over all pairs; texts without a word where they are equal."""
    w, root, text = weighted(rows), {i: i for i, _ in rows}, dict(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            same = (text[i] or "") == (text[j] or "") or w[i] and w[j] and (len(w[i].keys() & w[j].keys()) >= 0.8 * len(w[i].keys() | w[j].keys()) or weighted_jaccard(w[i], w[j]) >= 0.8 - 1e-9)
            if same:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def test_both_clauses_equal_brute_force(spark):
    """Pairs that the weights alone link, by lines that stand in many texts and by repeated lines, and pairs that they part; recall is 1 here."""
    rng = random.Random(21)
    new = lambda n: " ".join(f"n{rng.randrange(10**9)}" for _ in range(n))
    common = [new(40) for _ in range(3)]
    texts = [f"{new(60)} {common[k % 3]}" for k in range(60)]
    for _ in range(40):  # the same rare text beside different common lines: plain 0.7, weighted above
        own = new(104)
        texts += [f"{own} {common[0]}", f"{own} {common[1]}"]
    for _ in range(20):  # a line many times in both, few other words in common by set, most by weight
        line = new(12)
        texts += [" ".join([line] * 30 + [new(2)]), " ".join([line] * 30 + [new(2)])]
    texts += [edited(rng, texts[0], 3) for _ in range(5)]
    rows = list(enumerate(texts))
    want = brute_both(rows)
    plain = brute(rows)
    assert want != plain  # the weights decide something here
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == want


def test_weights_do_not_depend_on_the_partitions(spark):
    rng = random.Random(5)
    line = "one very common line of text here"
    rows = [(k, f"{line} " + " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = neardup.frequent(docs.coalesce(1), "text", 300), neardup.frequent(docs.repartition(40), "text", 300)
    assert few.hashes.tolist() == many.hashes.tolist() and few.idf.tolist() == many.idf.tolist() and len(few.hashes) >= 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(50)] + [(2000 + k, 2000 + k // 2) for k in range(1, 60)] + [(5000, 5001)]
    rng.shuffle(edges)
    links = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "id long, other long")
    got = {r.id: r.root for r in neardup.components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1051)} | {k: 2000 for k in range(2000, 2060)} | {5000: 5000, 5001: 5000}


def _pairs(rows):
    """Classes by both clauses over all pairs of texts that share a shingle or are equal, by an index of shingles."""
    from collections import Counter, defaultdict

    w, text = weighted(rows), dict(rows)
    holders = defaultdict(list)
    for i, x in w.items():
        for s in x:
            holders[s].append(i)
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, t in sorted(text.items()):
        if not w[i]:
            root[top(i)] = top(first.setdefault(t or "", i))
    for i in sorted(w):
        shared = Counter(j for s in w[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(w[i]) + len(w[j]) - n) or weighted_jaccard(w[i], w[j]) >= 0.8 - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def test_classes_of_whole_documents(spark):
    """The thousand documents of a given table, whole: no link between two classes is lost, and none is made."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = _pairs(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)
