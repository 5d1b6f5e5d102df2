import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm.common import cut
from inkwell.llm.pii import find
from test_neardup import brute_both

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "private", "packing"]

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["language"])
    assert all(before[i] == after[i] for i in after)
    assert all(not any(c.isalpha() for c in before[i] or "") for i in before.keys() - after.keys())

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["exact"])
    best = {}
    for i, t in before.items():
        best[t] = max(best.get(t, i), i)
    assert after == {i: t for t, i in best.items()}

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["near"])
    assert set(after) == set(brute_both(sorted(before.items())).values())

    before, after = ({r.doc_id: (r.text, r.n_chars) for r in x.collect()} for x in seen["private"])
    base = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert before.keys() == after.keys()
    for i, (t, _) in before.items():
        clean, n = after[i]
        assert n == len(clean) and base.search(clean) is None and clean.count("[EMAIL]") <= len(base.findall(t))
        # what is not replaced stays, in its order
        at = 0
        for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|ADDRESS|ACCOUNT|SECRET)\]", clean):
            at = t.index(piece, at) + len(piece)
        assert (clean == t) == (find(t) == {k: [] for k in find("")})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, (t, _) in after.items()}
    packs = seen["packing"][1].toPandas()
    assert packs.groupby("doc_id")["length"].sum().to_dict() == left
    used = packs.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and sorted(used.index) == list(range(len(used)))
    assert np.array_equal(packs.groupby("sequence_id")["offset"].min().to_numpy(), np.zeros(len(used)))
