import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import linededup
from inkwell.llm.linededup import Shard, drop_repeated_lines, line_digests

BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _brute(texts, least):
    found = Counter(k for t in texts for k in {_key(x) for x in (t or "").split("\n")} if k)
    return [[x for x in (t or "").split("\n") if not (_key(x) and found[_key(x)] >= least)] for t in texts]


def _texts():
    rng = random.Random(1)
    common = ["Subscribe NOW ", "\tsubscribe now\r", "Ünïcode Línea", "ünïcode Línea", "all rights reserved", " all Rights Reserved\x0b", " all rights reserved"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.3 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    return texts + ["hot line\nown"] * 90 + [None, "", "\n\n", " \n\t", "all rights reserved"] + ["\n".join(["twice"] * 50), "x" * 300_000 + "\nhot line\n" + "\n".join(f"long {k}" for k in range(20_000))]


@pytest.mark.parametrize("held", [linededup.HELD, 0])
def test_against_counting_all_lines(spark, held):
    """In every worker (HELD) and by requests (0); shards of 40 keys."""
    texts = _texts()
    docs = spark.createDataFrame([(k, t, 1, "r") for k, t in enumerate(texts)], "doc_id long, text string, n_lines int, row string").repartition(5)
    size, linededup.SHARD = linededup.SHARD, 40
    try:
        got = {r.doc_id: r for r in drop_repeated_lines(docs, 10, held=held).collect()}
    finally:
        linededup.SHARD = size
    kept = _brute(texts, 10)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k].asDict() == {"doc_id": k, "text": None if t is None else "\n".join(kept[k]), "n_lines": 1, "row": "r", "n_lines_": len((t or "").split("\n")), "n_dropped": len((t or "").split("\n")) - len(kept[k])}, k


def test_digests_repeated_rows_and_empty_table(spark):
    rows = [(1, "a\nb")] * 5 + [(None, "a")] * 5 + [(2, "A \nc"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(1, 2, 1, sha("b"))] * 5 + [(0, 1, 1, sha(""))] * 5 + [(2, 2, 1, sha("c")), (3, 1, 0, sha(""))])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_digests(empty).count() == 0 and line_digests(empty, held=-1).count() == 0
    few = spark.createDataFrame([(1, "x\ny")], "doc_id long, text string")
    assert [(r.n_lines, r.n_dropped) for r in line_digests(few, held=-1).collect()] == [(2, 0)]
    with pytest.raises(ValueError, match="least"):
        drop_repeated_lines(few, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    if n > 2:
        hi[1] = hi[0]  # keys that share half of their hash
    counts = rng.integers(1, 70_000, n)
    shard = Shard.read(Shard.made(hi, lo, counts).row(3))
    assert len(shard.prints) == n and sorted(shard.prints.tolist()) == sorted(lo.tolist())
    assert shard.found(hi, lo).tolist() == counts.tolist()
    other = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert not shard.found(other, other).any()
    assert n < 1000 or len(shard.bits) * 8 < 6 * n
