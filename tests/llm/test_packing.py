import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkwell.llm.packing import packed, patterns

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_patterns_use_every_piece_once():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([8, 64, 2048])
        histogram = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(0, 30))}
        used = {}
        for pattern, count in patterns(histogram, size):
            assert sum(pattern) <= size and count > 0
            for n in pattern:
                used[n] = used.get(n, 0) + count
        assert used == histogram


def test_packed_against_the_tokenizer(spark):
    rng = random.Random(1)
    texts = [None, "", " \x1c a\x1fb ", "Ünïcode ΣΑΣ <|endoftext|>x İ 12,3", "w" * 9000, "a.b,c ...x ,.y z_. _,q 3.5,6 's. 'll, e.'s \u00ba.\u00aa ,\u2019. A.B",  "it's don't've a.b,c. 1½ ªb x² 'S Ångström İi e\u0301x naïve... '' <|x", *(" ".join(rng.choice(["the", "Heron.", "aéi", "42", "?!"]) for _ in range(rng.randint(0, 3000))) for _ in range(40))]
    rows = [(k % 43, t, "x", 0) for k, t in enumerate(texts)]  # some ids twice
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, part string, rank int").repartition(3), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows)
    crcs = sorted((i, s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for i, ids in want for s in range(0, len(ids), 2048))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == crcs
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
