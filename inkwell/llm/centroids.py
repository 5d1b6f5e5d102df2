"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors, in exact integers.

1. A vector becomes its integers floor(scale x), packed into the narrowest bytes that hold them; equal vectors become one row with a multiplicity.
2. The first centroids are those of the smallest hashes of their ids. In each round a worker assigns the distinct vectors and sends, for each centroid, the weighted
   sums of the components; Spark adds them up, and a round's sums, one number for a component of a centroid, give the next centroids.
3. Assignments are joined back to the ids by the packed vector. A vector of over a thousandth of all rows, one of under a thousand, meets its rows by a
   broadcast, so no task gets the rows of a hot vector.

Distances are exact: by float products where all integers below 2 ** 53 do, else by integers of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, own_worker

#: Hot: over one in so many of all rows. Vectors that a worker assigns at once. Sums go in limbs of so many bits, which 2 ** 22 tasks cannot overflow.
HOT_SHARE, AT_ONCE, LIMB = 1000, 4096, 40
#: Components up to this size take the float path: 4 x 64 x 2 ** 44 < 2 ** 53.
WIDE = 2.0**22
LONG_MAX = 2**63 - 1


def quantised(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, key): the vectors of ``size`` finite components as packed integers floor(scale x), a tag byte before them."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where((F.size("x") == size) & F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e * scale) < float("inf")), F.lit(False))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("centroids", lambda: None)
        for batch in batches:
            if batch.num_rows:
                v = np.floor(batch.column(1).flatten().to_numpy().reshape(-1, size) * scale) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(v), pa.binary())], ["id", "key"])

    return whole.mapInArrow(work, "id long, key binary")


def _packed(v: np.ndarray) -> list[bytes]:
    """Rows of whole doubles as the narrowest of 1, 2 and 4-byte integers and doubles, so that equal rows have equal bytes."""
    most = np.where(v >= 0, v, -v - 1).max(axis=1)
    out: list[bytes] = [b""] * len(v)
    for tag, kind, bound in ((1, "<i1", 2.0**7), (2, "<i2", 2.0**15), (4, "<i4", 2.0**31), (8, "<f8", np.inf)):
        at = np.flatnonzero((most < bound) & (most >= {1: -1, 2: 2.0**7, 4: 2.0**15, 8: 2.0**31}[tag]))
        rows = v[at].astype(kind)
        for k, row in zip(at.tolist(), rows, strict=True):
            out[k] = bytes([tag]) + row.tobytes()
    return out


def unpacked(keys: list[bytes]) -> np.ndarray:
    kinds = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}
    if keys and all(k[0] == 1 for k in keys):  # the usual case at once
        return np.frombuffer(b"".join(keys), "<i1").reshape(len(keys), -1)[:, 1:].astype(np.float64)
    return np.array([np.frombuffer(k, kinds[k[0]], offset=1).astype(np.float64) for k in keys])


def assigned(v: np.ndarray, centroids: list[tuple[int, ...]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row, the first of equals, and the squared distance, exactly."""
    if float(np.abs(v).max(initial=0.0)) <= WIDE and all(abs(x) <= WIDE for c in centroids for x in c) and v.shape[1] <= 64:
        c = np.array(centroids, np.float64)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(v)), best].astype(np.int64).tolist()
    rows = [[int(x) for x in row] for row in v.tolist()]
    found = [min((sum((x - y) ** 2 for x, y in zip(row, c, strict=True)), k) for k, c in enumerate(centroids)) for row in rows]
    return np.array([k for _, k in found], np.int64), [d for d, _ in found]


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """x = the sum of limb << (LIMB number), limbs not zero and of x's sign."""
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x:
        if low := x & ((1 << LIMB) - 1):
            yield k, sign * low
        x, k = x >> LIMB, k + 1


def _sums(rows: DataFrame, centroids: list[tuple[int, ...]]) -> dict[int, tuple[int, list[int]]]:
    """By centroid that has vectors: how many, and the sums of their components. What comes to the driver is a number or few for each component of a centroid."""
    size = len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("centroids", lambda: None)
        held = {}
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                v, weight = unpacked(part.column(0).to_pylist()), part.column(1).to_numpy()
                best, _ = assigned(v, centroids)
                small = float(np.abs(v).max(initial=0.0)) * float(weight.sum()) < 2.0**53
                for c in np.unique(best).tolist():
                    at = best == c
                    if small:
                        sums = [int(x) for x in (weight[at].astype(np.float64) @ v[at]).tolist()]
                    else:
                        sums = [sum(int(x) * w for x, w in zip(col, weight[at].tolist(), strict=True)) for col in v[at].T.tolist()]
                    n, own = held.get(c, (0, [0] * size))
                    held[c] = n + int(weight[at].sum()), [x + y for x, y in zip(own, sums, strict=True)]
        out = [(c, p, k, x) for c, (n, sums) in held.items() for p, total in enumerate([n, *sums]) for k, x in _limbs(total)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "place", "limb", "x"])

    found: dict[int, list[int]] = {}
    for r in rows.mapInArrow(work, "c int, place int, limb int, x long").groupBy("c", "place", "limb").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r.c, [0] * (size + 1))[r.place] += r.x << (LIMB * r.limb)
    return {c: (x[0], x[1:]) for c, x in found.items()}


def _long(x: Column) -> Column:
    """A whole decimal as a long, null where a long cannot hold it."""
    return F.when(x <= F.lit(LONG_MAX).cast("decimal(38,0)"), x).cast("long")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null, not finite, or so large that ``scale`` times it is not finite. The first centroids are
    the ``k`` kept rows with the smallest SHA-256 of 1:id (all, if fewer; of repeated ids each row counts, the smaller packed vector first; a null id is never
    one), in that order. Equal distances go to the smaller number; a centroid without vectors stays. Where only null ids are kept, cluster and what follows
    from it are null. A distance or sum that a long cannot hold is null. Repeated rows and null ids come back as often as they stand; other columns, whatever
    their names, are ignored. An empty table gives an empty result.
    """
    rows = cut(quantised(vectors, size, scale, id_col, vector_col), "quantised")
    first = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "key").orderBy("h", "key").limit(k).collect()
    schema = "key binary, cluster int, distance decimal(38,0)"
    distinct = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    total = distinct.agg(F.sum("weight")).first()[0] or 0
    centroids = [tuple(int(x) for x in v) for v in unpacked([r.key for r in first]).tolist()]
    for _ in range(rounds if centroids else 0):
        sums = _sums(distinct, centroids)
        centroids = [tuple(x // sums[c][0] for x in sums[c][1]) if c in sums else own for c, own in enumerate(centroids)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        own_worker("centroids", lambda: None)
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                if centroids:
                    best, d = assigned(unpacked(part.column(0).to_pylist()), centroids)
                    best, d = pa.array(best, pa.int32()), pa.array([Decimal(x) if x <= LONG_MAX else None for x in d], pa.decimal128(38, 0))
                else:
                    best, d = pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), best, d, part.column(1)], ["key", "cluster", "distance", "weight"])

    found = cut(distinct.mapInArrow(work, schema + ", weight long"), "assigned")
    # a sum that misses a distance is null
    weighed = F.col("distance") * F.col("weight").cast("decimal(19,0)")
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum(weighed.cast("decimal(38,0)")))
    inertia = found.groupBy("cluster").agg(whole.alias("sum")).collect()  # a row a centroid
    own = {r.cluster: int(r.sum) if r.sum is not None else None for r in inertia}
    overall = sum(own.values()) if own and None not in own.values() else None
    held = lambda x: x if x is not None and x <= LONG_MAX else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = vectors.sparkSession.createDataFrame([(c, held(own.get(c)), held(overall), sha[c]) for c in range(len(centroids))], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    known = found.select(F.col("key").alias("of"), "cluster", _long(F.col("distance")).alias("distance"), "weight")
    hot, on = F.col("weight") * HOT_SHARE > total, F.col("key") == F.col("of")
    often = F.broadcast(known.where(hot))
    joined = rows.join(often, on).unionByName(rows.join(often, on, "left_anti").join(known.where(~hot), on))
    return joined.join(F.broadcast(about), F.col("cluster") == F.col("number"), "left").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
