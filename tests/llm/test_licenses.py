import random
import re

import pyarrow as pa

from inkwell.llm.licenses import BASE, TEMPLATES, index, scanned


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(k, label) for k in range(len(words)) for p, label in BASE.items() if words[k : k + len(p.split())] == p.split()]
    return len(words), sorted(places)


def test_base_equals_brute_force():
    rng = random.Random(3)
    pieces = ["MIT", "mit", "License", "license", "licenses", "Apache", "gnu", "General", "public", "CC", "BY", "cc-by", ",", ".", " ", " ", "\n", "é", "-", "ª", "", "x7"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 15)))
        n, places, _, _ = index().scan(text)
        assert (n, sorted(places)) == brute(text), text


def test_templates_are_found_with_edits_and_not_in_prose():
    for label, (text, _) in TEMPLATES.items():
        words = ("lorem ipsum " * 50 + text + " dolor" * 40).split()
        assert label in index().scan(" ".join(words))[2]
        del words[98 + len(text.split())]
        assert label in index().scan(", ".join(words).upper())[2]
    assert index().scan("the public license to use free software as a source of permission is a notice " * 20)[2] == set()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "MIT license, mit License", 3), (3, "MIT license, mit License", 3), (None, "a " * 60_000, 4)], "doc_id long, text string, score int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scanned(docs).collect())
    assert got == [(0, 60_000, 0, None, None, "", "", 0.0), (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), *[(3, 4, 2, 0, 2, "mit", "mit", 1.0)] * 2]
    assert scanned(docs.limit(0)).count() == 0


def aligned(text):
    """The method's labels and score by brute force: every template at every beginning, over all the words of the text."""
    from collections import Counter

    from inkwell.llm.licenses import AGREE, DRIFT, LEAST, RARE

    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    templates = {label: (t.split(), [p.split() for p in must]) for label, (t, must) in TEMPLATES.items()}
    seen = Counter(w for t, _ in templates.values() for w in set(t))
    labels, best = set(), 0.0
    for label, (t, must) in templates.items():
        own = {w for w in t if seen[w] <= RARE * len(templates)}
        for cell in range(-len(t) // DRIFT - 2, len(words) // DRIFT + 2):
            agreed = len({w for k, w in enumerate(t) if w in own for j in range(max(0, k + cell * DRIFT), min(len(words), k + (cell + 2) * DRIFT)) if words[j] == w})
            if agreed >= LEAST and agreed >= AGREE * len(own):
                window = words[max(0, cell * DRIFT - 2 * DRIFT) : max(0, cell * DRIFT + len(t) + 4 * DRIFT)]
                if all(any(window[k : k + len(p)] == p for k in range(len(window))) for p in must):
                    labels.add(label)
                    best = max(best, agreed / len(own))
    return labels, best


def test_labels_and_score_equal_brute_force():
    rng = random.Random(12)
    pool = [w for t, _ in TEMPLATES.values() for w in t.split()] + ["lorem", "ipsum", "dolor"] * 40
    texts, marked = [], 0
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        for t, _ in rng.sample(list(TEMPLATES.values()), rng.randint(0, 2)):
            own = t.split()
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            at = rng.randint(0, len(words))
            words[at:at] = own[rng.randint(0, 10) : len(own) - rng.randint(0, 10)]
        texts.append(" ".join(words))
    for text, (_, _, labels, best) in zip(texts, index().scan_all(pa.array(texts)), strict=True):
        want, score = aligned(text)
        assert (labels, round(best, 9)) == (want, round(score, 9)), text
        marked += bool(want)
    assert marked > 10


PROSE = (
    "All of the authors agreed that an action of this kind would also be hard to copy, and any person who had read the notice could obtain a further view of the matter. "
    "It was, in the event, a work of some purpose: the conditions were met, the list of rights was long, and nobody would be held liable for the claim that had been made. "
)


def test_every_licence_behind_english_prose():
    for label, (text, _) in TEMPLATES.items():
        for page in (PROSE + text, PROSE * 40 + text + PROSE * 40, text + PROSE):
            assert label in index().scan(page)[2], label
            assert label in aligned(page[:4000] if page.startswith(text) else PROSE + text)[0]
    assert index().scan(PROSE * 50)[2:] == (set(), 0.0)


def test_notice_files_of_many_licences():
    """All templates in one file, and every window of six of them, with prose between."""
    items = list(TEMPLATES.items())
    assert index().scan(PROSE.join(t for _, (t, _) in items))[2] >= set(TEMPLATES)
    for k in range(len(items) - 5):
        some = items[k : k + 6]
        page = "\n\n".join(f"{n}. {t.capitalize()}.\n" for n, (_, (t, _)) in enumerate(some))
        labels, score = index().scan(page)[2:]
        assert labels >= {label for label, _ in some}, (k, labels)
        assert (labels, score) == aligned(page)


def test_long_texts_in_linear_time():
    import time

    text = " ".join(t for t, _ in TEMPLATES.values())
    began = time.time()
    labels = index().scan((text + " ") * 300)[2]
    assert labels >= set(TEMPLATES) and time.time() - began < 20
