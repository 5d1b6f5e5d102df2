import math
import random
from fractions import Fraction

from inkwell.llm.topk import top_k


def brute(rows, every, k):
    rows = {(i, tuple(math.floor(256 * Fraction(x)) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in rows:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)], k) for k in range(600)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(200)]  # one very common vector
    rows += [(5000, None, 1), (5010, [], 1), (5020, [1.0, None], 1), (5030, [math.nan] * 8, 1), (5040, [math.inf] * 8, 1), (None, [0.1] * 8, 1), (5050, [0.5, 0.25], 1), (5060, [2.0, 1.0], 1)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(docs, every=10).collect())
    assert got == brute(rows, 10, 5)


def test_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in top_k(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)).collect()] == [(0, 1, 1, -65536)]


def test_large_components_and_other_k(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([0.0, -0.0, 0.004, 1.0, -2.5, 1e5]) for _ in range(3)], 0) for k in range(60)]
    rows += [(100, [2e13, 1.0, 0.0], 0), (110, [1e300, -1.0, 0.0], 0), (121, [-1e300, 2e13, 5.0], 0), (133, [1e17, 1e17, -1e17], 0), (140, [-0.0039, 2.0**44, 0.1], 0)]
    rows += [(200 + k, [9.0, 9.0, 9.0], 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    for k in (1, 10):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(docs, every=10, k=k).collect())
        assert got == brute(rows, 10, k)
    two = spark.createDataFrame([(0, [1.0]), (1, [2e13]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(two).orderBy("rank").collect()] == [(0, 1, 1, 256 * 256 * 20_000_000_000_000), (0, 2, 2, 65536)]


def test_queries_in_several_blocks(spark, monkeypatch):
    from inkwell.llm import topk

    monkeypatch.setattr(topk, "QUERY_BYTES", 400)
    monkeypatch.setattr(topk, "SHARE", 6)  # and the candidates of a query in several shares
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(4)], k) for k in range(150)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(docs, every=5).collect())
    assert got == brute(rows, 5, 5)
