"""Exact top-k inner-product search over vector-approximation files.

1. Components become floor(256 x), kept exactly as doubles of floor(256 x) / 256. Of equal vectors the k + 1 smallest ids are enough; only vectors that may
   be repeated, by the two-pass Bloom filter, meet for that.
2. The approximation file is written once: blocks of ids and one quantised cell (a byte) per component, with the block's lower edges and cell widths.
   Exact vectors stay in a file of their own.
3. Queries go out in blocks of a bounded size (``QUERY_BYTES``), broadcast one after another; each block scans the approximation file alone, which
   gives every score a lower and an upper bound. A row is a candidate of a query where its upper bound reaches the k-th lower bound.
4. Exact vectors of the candidates alone are read, for each query in the order of their upper bounds, until the k-th exact score is above
   all bounds that are left. The candidates of a query with many of them are dealt to several tasks, each of which reads its own in that order; so no task has
   all of them, and each block's scores are appended to one file, so the plan does not grow with the blocks.
Vectors with a component beyond ``WIDE`` have no useful cells: pairs with one of them are scored exactly, in integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import _remove_at_exit, cut, new_path
from inkwell.llm.exact_dedup import maybe_repeated, member_filter, repeated_filter

K = 5
#: Rows of a block of the approximation file, cells of a component, bytes of queries that are broadcast at once, queries that are scanned at once.
ROWS, LEVELS, QUERY_BYTES, AT_ONCE = 4096, 256, 32 << 20, 256
#: Candidates of a query that a task reads, about.
SHARE = 256
#: Components up to this size have cells.
WIDE = 2.0**40
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def floored(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, d, wide): floor(256 x) / 256 of the vectors that take part; repeated rows are one."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    whole = whole.where(F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    # from 2 ** 44 on a double times 256 is whole; adding 0 turns -0 into 0
    v = F.transform("x", lambda e: F.when(F.abs(e) < 2.0**44, F.floor(e * 256).cast("double") / 256 + 0.0).otherwise(e))
    return whole.select("id", v.alias("v")).withColumn("d", F.size("v")).withColumn("wide", F.exists("v", lambda e: F.abs(e) > WIDE)).dropDuplicates(["id", "v"])


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, which are enough for k places, the query's own aside. Vectors that are alone for certain are not shuffled."""
    key = F.xxhash64("v")
    bloom, blocks = repeated_filter(rows, key, rows.count())
    probed = maybe_repeated(rows, key, bloom, blocks, "again")
    first = Window.partitionBy("v").orderBy("id")
    few = probed.where("again").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    return probed.where("NOT again").select(*rows.columns).unionByName(few.select(*rows.columns))


def _matrix(batch: pa.RecordBatch, at: np.ndarray, column: int, d: int) -> np.ndarray:
    return batch.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def approximated(rows: DataFrame) -> DataFrame:
    """The approximation file: (d, ids, low, width, cells), blocks of at most ROWS rows of one dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for dim in np.unique(d).tolist():
                of = np.flatnonzero(d == dim)
                for a in range(0, len(of), ROWS):
                    at = of[a : a + ROWS]
                    v = _matrix(batch, at, 1, dim)
                    low = v.min(axis=0)
                    width = (v.max(axis=0) - low) / LEVELS
                    cells = np.clip(np.floor((v - low) / np.where(width > 0, width, 1)), 0, LEVELS - 1).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({"d": pa.array([dim], pa.int32()), "ids": [ids[at].astype("<i8").tobytes()], "low": [low.astype("<f8").tobytes()], "width": [width.astype("<f8").tobytes()], "cells": [cells.tobytes()]})

    return rows.select("id", "v", "d").mapInArrow(work, "d int, ids binary, low binary, width binary, cells binary")


def _kept(lower: np.ndarray, upper: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, row) pairs may be among the k best, and the k best lower bounds of each query so far; those of rows that are no candidates are -inf."""
    both = np.concatenate([best, lower], axis=1)
    best = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
    least = best.min(axis=1) if best.shape[1] >= k else np.full(len(best), -np.inf)
    return (upper >= least[:, None]) & (lower > -np.inf), best


def _bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores [query][row]; a relative margin covers the rounding of floats."""
    centre = low + (cells + 0.5) * width
    middle = queries @ centre.T
    slack = np.abs(queries) @ (width / 2)
    slack = slack + 1e-9 * (np.abs(queries) @ np.abs(centre).max(axis=0, initial=0.0) + 1e-9)
    return middle - slack[:, None], middle + slack[:, None]


def _integers(v: np.ndarray) -> list[int]:
    """256 v, exactly."""
    return [int(x * 256) if abs(x) < 2.0**60 else int(x) * 256 for x in v.tolist()]


def exact_scores(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products of 256 times the vectors, exactly: in 64 bits where nothing can overflow, else in integers of any size."""
    if float(np.abs(query).sum()) * float(np.abs(rows).max(initial=0.0)) * 65536 < 2.0**62 and float(np.abs(query).max(initial=0.0)) < 2.0**54:
        return ((rows * 256).astype(np.int64) @ (query * 256).astype(np.int64)).tolist()
    q = _integers(query)
    return [sum(x * y for x, y in zip(_integers(r), q, strict=True)) for r in rows]


class Queries:
    """A block of queries by dimension: ids, and vectors as rows; wide tells those with a component that has no cell."""

    def __init__(self, rows: list) -> None:
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in {r.d for r in rows}:
            own = sorted((r for r in rows if r.d == d), key=lambda r: r.id)
            self.by[d] = np.array([r.id for r in own], np.int64), np.array([r.v for r in own], np.float64).reshape(len(own), d), np.array([r.wide for r in own], bool)
        self.place = {(d, i): k for d, (ids, _, _) in self.by.items() for k, i in enumerate(ids.tolist())}


def _candidates(file: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, id, d, upper, lower) of the pairs that the approximation file cannot rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((len(ids), k), -np.inf) for d, (ids, _, _) in shared.value.by.items()}
        for batch in batches:
            for d, ids, low, width, cells in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in range(1, 5)), strict=True):
                if d not in best:
                    continue
                of = lambda x, t: np.frombuffer(x.as_buffer(), t)
                ids = of(ids, "<i8")
                cells = of(cells, np.uint8).reshape(len(ids), d).astype(np.float64)
                query_ids, queries, wide = shared.value.by[d]
                for a in range(0, len(query_ids), AT_ONCE):
                    b = a + AT_ONCE
                    lower, upper = _bounds(queries[a:b], of(low, "<f8"), of(width, "<f8"), cells)
                    lower[(query_ids[a:b, None] == ids[None, :]) | wide[a:b, None]] = -np.inf
                    some, best[d][a:b] = _kept(lower, upper, k, best[d][a:b])
                    q, r = np.nonzero(some)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[a:b][q]), pa.array(ids[r]), pa.array(np.full(len(q), d, np.int32)), pa.array(upper[q, r]), pa.array(lower[q, r])], names=["query_id", "id", "d", "upper", "lower"])

    return file.mapInArrow(work, "query_id long, id long, d int, upper double, lower double")


def _verified(ordered: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, id, key, score) of exact scores, for each share of a query's candidates in the order of their upper bounds until the k-th is above all that are left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scores, done = None, [], False
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)]
            vectors = batch.column(4)
            for n, (query, i, d, upper, share) in enumerate(zip(*columns, strict=True)):
                if (query, share, d) != now:
                    now, scores, done = (query, share, d), [], False
                if done or len(scores) >= k and scores[k - 1] > upper * 65536 * (1 + 1e-9 * (1 if upper > 0 else -1)):
                    done = True
                    continue
                _, rows, _ = shared.value.by[d]
                score = exact_scores(rows[shared.value.place[d, query]], vectors[n].values.to_numpy(zero_copy_only=False).reshape(1, d))[0]
                scores = sorted([*scores, score], reverse=True)[:k]
                out.append((query, i, score))
            if out:
                yield _scored(out)

    return ordered.mapInArrow(work, "query_id long, id long, key string, score long")


def order_key(score: int) -> str:
    """A text that sorts as the integer does, whatever its size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}{digits.translate(NINES)}"


NINES = str.maketrans("0123456789", "9876543210")


def _scored(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """(query_id, id, key, score): the key ranks exactly; a score beyond 64 bits is the nearest long."""
    scores = [max(LONG_MIN, min(LONG_MAX, r[2])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([order_key(r[2]) for r in rows], pa.string()), pa.array(scores, pa.int64())], names=["query_id", "id", "key", "score"])


def _exhaustive(rows: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, id, key, score) of the pairs in which a wide vector takes part: the k best of each query in each batch, exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d, wide = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for dim, (query_ids, queries, query_wide) in shared.value.by.items():
                of = np.flatnonzero(d == dim)
                if not len(of):
                    continue
                v = _matrix(batch, of, 1, dim)
                for i, q, w in zip(query_ids.tolist(), queries, query_wide.tolist(), strict=True):
                    at = np.flatnonzero((ids[of] != i) & (wide[of] | w))
                    if len(at):
                        scores = exact_scores(q, v[at])
                        best = sorted(zip((-s for s in scores), ids[of][at].tolist(), strict=True))[:k]
                        yield _scored([(i, r, -s) for s, r in best])

    return rows.select("id", "v", "d", "wide").mapInArrow(work, "query_id long, id long, key string, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose id is divisible by ``every``, its k best among all other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows of a null id. Vectors of different length have no inner
    product: each query meets those of its own length, and an empty vector scores 0 with another. Repeated rows count once; a query with fewer than k
    candidates gets all. Scores are exact whatever the size of the components; one beyond 64 bits is returned as the nearest long and ranked by its
    true value. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(floored(vectors, id_col, vector_col), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    kept = cut(_distinct(rows, k), "exact")
    file = cut(approximated(kept.where("NOT wide")), "approximations")
    any_wide = not rows.where("wide").isEmpty()
    n, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(0))).first()
    passes = max(1, -(-n * max(widest, 1) * 8 // QUERY_BYTES))
    path = new_path(spark, "scores")
    _remove_at_exit(spark, path)
    for p in range(passes):
        # bounded: QUERY_BYTES on average, as ids are dealt by their hash
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else asked
        shared = spark.sparkContext.broadcast(Queries(block.select("id", "v", "d", "wide").collect()))
        maybe = cut(_candidates(file, shared, k), "candidates")
        # the k-th lower bound of a query: of the k best of each of its shares, the k best
        counts = cut(maybe.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")), "counts")  # a row a query of the block
        dealt = maybe.join(F.broadcast(counts), "query_id").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("lower")))
        few = dealt.select("query_id", "share", "lower").withColumn("place", place("query_id", "share")).where(F.col("place") <= k)
        least = few.withColumn("place", place("query_id")).where(F.col("place") <= k).groupBy("query_id").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
        left = dealt.join(F.broadcast(least), "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("query_id", "share", "id", "d", "upper")
        left = cut(left, "left")
        wanted = left.select("id").distinct()
        bloom, blocks = member_filter(wanted, F.col("id"), wanted.count())
        # of the exact file only rows that may be candidates are shuffled
        exact = maybe_repeated(kept.where("NOT wide").select(F.col("id").alias("vid"), F.col("d").alias("vd"), "v"), F.col("vid"), bloom, blocks, "in").where("in").drop("in")
        both = left.join(exact, (F.col("id") == F.col("vid")) & (F.col("d") == F.col("vd")))
        ordered = both.repartition("query_id", "share").sortWithinPartitions("query_id", "share", "d", F.desc("upper")).select("query_id", "id", "d", "upper", "v", "share")
        scores = _verified(ordered, shared, k)
        if any_wide:
            scores = scores.unionByName(_exhaustive(kept, shared, k))
        scores.write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    found = spark.read.schema("query_id long, id long, key string, score long").parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
