import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import centroids
from inkwell.llm.centroids import LONG_MAX, assigned, clusters, unpacked

SCHEMA = "vec_id long, embedding array<double>, cluster string, key int, `a.b` int"


def _brute(rows, size, k=16, rounds=3, scale=64):
    """Lloyd over every row, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), centroids._packed(np.array([v], float))[0], v) for i, v in kept if i is not None))[:k]
    c = [v for _, _, v in first]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, own, strict=True)), n) for n, own in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(col) // of.count(n) for col in zip(*(v for (_, v), m in zip(kept, of, strict=True) if m == n), strict=True)] if n in of else c[n] for n in range(len(c))]
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, n in last:
        inertia[n] += d
    fit = lambda x: x if x <= LONG_MAX else None
    return sorted((i if i is not None else -1, n, fit(d) or (0 if d == 0 else -1), fit(inertia[n]) or (0 if inertia[n] == 0 else -1), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True))


def _got(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, -1 if r.distance is None else r.distance, -1 if r.cluster_inertia is None else r.cluster_inertia, r.centroid_sha256) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], SCHEMA).repartition(4)


def test_against_lloyd_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, -0.0, 1.0]) for i in range(120)]  # a hot vector, -0 and 0
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1])]  # repeated rows, a null id
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [1.0, float("nan"), 0, 0, 0.0]), (2004, [float("inf"), 0, 0, 0, 0.0]), (2005, [1.0] * 4), (2006, [1.0] * 6)]
    got = clusters(_table(spark, rows), size=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _got(got) == _brute(rows, 5)
    total = {r.inertia for r in got.collect()}
    assert total == {sum(d for _, _, d, _, _ in _brute(rows, 5))}


def test_components_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e-3, 1.0, 3e4, 1e9]) * rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(90, [1e25, -1e25, 0.5]), (91, [-1e25, 3.0, 1e300])]
    assert _got(clusters(_table(spark, rows), k=4, size=3)) == _brute(rows, 3, 4)
    # 64 times the component is not finite: such a vector takes no part
    assert clusters(_table(spark, [(1, [1e308, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])]), size=3).count() == 1


def test_few_rows_ties_and_nulls(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(6)]
    got = _got(clusters(_table(spark, rows), size=2))
    assert got == _brute(rows, 2) and {r[2] for r in got} == {0}  # equal first centroids: the smaller number takes all, the others stay
    assert len({r[1] for r in got}) == 2
    null = clusters(_table(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])]), size=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia, r.centroid_sha256) for r in null] == [(None, None, None, None, None)] * 2
    assert clusters(_table(spark, []), size=2).count() == 0
    floats = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id int, embedding array<float>")
    assert sorted(r.distance for r in clusters(floats).collect()) == [0, 0]


@pytest.mark.parametrize("big", [False, True])
def test_assignment_and_packing(big):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 1 if not big else 1e12, (200, 6)) * 100)
    assert (unpacked(centroids._packed(v)) == v).all()
    own = [tuple(int(x) for x in row) for row in v[:5].tolist()] + [tuple(int(x) for x in v[0].tolist())]
    best, d = assigned(v, own)
    want = [min((sum((int(x) - y) ** 2 for x, y in zip(row, c, strict=True)), k) for k, c in enumerate(own)) for row in v.tolist()]
    assert list(zip(d, best.tolist(), strict=True)) == want
    for x in (0, 1, -1, 2**40, -(2**40), 12345678901234567890123, -(10**60)):
        assert sum(low << (centroids.LIMB * k) for k, low in centroids._limbs(x)) == x
