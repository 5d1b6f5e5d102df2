import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwell.llm.bpe import digests, encoded, loaded

PATH = public_tokenizers.path("byte_bpe_50k.json")
WANT = Tokenizer.from_file(PATH)


def mine(text):
    return loaded(PATH).encode(pa.array([text]))[0].tolist()


def want(text):
    return WANT.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "th", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "中", "👍🏽", "1", "!!", "<|endoftext|>", "　", "\x1c", "\x85", "ing", "x" * 30, "ſ", "-=", "=" * 17]), max_size=14).map("".join) | st.text(max_size=40))
def test_equals_the_library(text):
    assert mine(text) == want(text)


def test_words_that_fail_the_greedy_proposal():
    rng = random.Random(1)
    bpe = loaded(PATH).bpe
    words = ["".join(rng.choice("aeioutnshrdl") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["a" * k for k in range(1, 120)]
    ids, sizes = bpe.encode_words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [want(w) for w in words]
    ends = np.cumsum([len(w.encode()) for w in words])
    place, token = bpe._greedy(np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert len(place) == len(token) and token.tolist() != ids.tolist()  # the check is what makes them right


def test_compatibility_equals_merging_the_pair():
    bpe = loaded(PATH).bpe
    rng = np.random.default_rng(3)
    stable = np.array(list(bpe.stable_ids.values()))
    a, b = rng.choice(stable, 3000), rng.choice(stable, 3000)
    exact = [bpe._exact(bpe.tokens[x] + bpe.tokens[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert bpe._compatible(a, b).tolist() == exact


def test_documents(spark):
    long = "word " * 40_000
    rows = [(1, None, "x"), (2, "", "y"), (None, "tie <|endoftext|> \n\n<|endoftext|>", "z"), (3, long, "a"), (3, long, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    for r in digests(docs, PATH).collect():
        text = {1: "", 2: "", None: rows[2][1], 3: long}[r.doc_id]
        ids = want(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(WANT.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(r.decoded for r in encoded(docs, PATH).collect()) == sorted((t or "") for _, t, _ in rows)
    assert digests(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("ids", [[0, 255], [50256, 1], list(range(120, 200))])
def test_decoding_invalid_bytes(ids):
    bpe = loaded(PATH).bpe
    assert bpe.decode(np.array(ids)).decode("utf-8", "replace") == WANT.decode(ids, skip_special_tokens=False)
