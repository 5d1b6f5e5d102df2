"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Shingles of five words, hashed to 64 bits; weight tf x idf. idf counts every document, exactly: a first pass counts shingles by hashed cell, and only
   shingles of cells that at least ``SHARE`` of all documents hit are counted one by one in a second. Shingles in that share of documents
   get a weight between ``FLOOR`` and 1 by their frequency, rarer ones weigh 1, so the table of weights is bounded by mean length / SHARE.
2. Documents of equal words become one representative. ``BANDS`` x ``ROWS`` consistent weighted samples give each its band keys, and as many
   samples of its plain shingle set (weight 1, tf ignored) further ones, so that either similarity has candidates of its own.
   Weight 1 is sampled alike in both, so a text whose weights are all 1 has one set of keys, which meets both sets of another text.
3. In each band bucket every member is verified against the smallest one; members that fail are compared with all others of their
   bucket, in blocks of about ``BLOCK`` texts, so no task ever holds a whole hot bucket and no link between two components is lost.
   Of the links within a block only those that join two of its components are returned.
4. Links are contracted to connected components as DataFrames: a round points every text to its smallest neighbour, follows the pointers to
   their ends by doubling, and contracts, which takes a logarithmic number of rounds and steps whatever the shape.

Two texts are near-duplicates where the weighted Jaccard similarity, or that of the plain shingle sets, is ``SIMILAR`` or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import BLOCK_ROWS, cut, fresh, in_blocks, own_worker, summed, text_slices, whole
from inkwell.llm.exact_dedup import HOT_SHARE, maybe_repeated, member_filter
from inkwell.llm.licenses import IN_WORD

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
SHARE, FLOOR = 0.001, 0.25
BLOCK = 250
#: Entries of a sample's table of random variates. Each sample reads other bits of a shingle's hash, so two shingles share a variate in one sample of TABLE.
TABLE = 1 << 16
#: Cells in which shingles are counted first, and the blocks, at most, in which the counts are added up.
CELLS, CELL_BLOCKS = 1 << 20, 256
#: Shingle hashes that a task counts at once.
HELD = 4_000_000
#: Bytes of text that are shingled at once.
AT_ONCE = 1 << 20
#: Rows of a side, of some numbers each, that is broadcast: 16 MB at most.
SMALL = 200_000
#: Blocks to which one copy of a leader's text is dealt at once.
SPAN = 200

U = np.uint64
P = U(0x9E3779B97F4A7C15)
P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS[0]):
        one = np.ones(1, U)
        _POWERS[:] = [np.concatenate([one, np.cumprod(np.full(n + n // 8, p, U))]) for p in (P, P_INV)]
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(1, U), np.ones(1, U)]


class Shingled:
    """The shingles of some texts: for text k, hashes[ends[k-1]:ends[k]] are distinct and in order, with their tf; keys name the word sequence."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw])
        inside = IN_WORD[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(len(data))
        sums = np.concatenate([np.zeros(1, U), np.cumsum((LOWER[data] + U(1)) * power[: len(data)])])
        words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
        doc = np.searchsorted(stops, starts, side="right")
        counts = np.bincount(doc, minlength=len(texts))
        word_ends = np.cumsum(counts)
        self.keys: list[bytes] = []
        a = 0
        for k, b in enumerate(word_ends.tolist()):
            self.keys.append(hashlib.blake2b(words[a:b].tobytes() if b > a else b"text:" + raw[k], digest_size=16).digest())
            a = b
        # a document of fewer words than a shingle has one shingle of them all
        last = word_ends[doc] - 1 if len(doc) else doc
        at = np.arange(len(words))
        h = words.copy()
        for j in range(1, WORDS):
            more = at + j <= last
            nxt = np.where(more, words[np.minimum(at + j, max(len(words) - 1, 0))], U(j)) if len(words) else words
            h = _mix(h * P + nxt)
        opens = (at + WORDS - 1 <= last) | ((counts[doc] < WORDS) & (at == last - counts[doc] + 1)) if len(words) else np.zeros(0, bool)
        h, d = h[opens], doc[opens]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.hashes = h[first]
        self.tf = np.diff(np.concatenate([first, [len(h)]])).astype(np.float64)
        self.ends = np.cumsum(np.bincount(d[first], minlength=len(texts)))

    def of(self, k: int, values: np.ndarray) -> np.ndarray:
        return values[self.ends[k - 1] if k else 0 : self.ends[k]]


class Weights:
    """idf of the frequent shingles (sorted hashes), 1 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = np.maximum(counts[order] / max(documents, 1), SHARE)
        self.idf = FLOOR + (1 - FLOOR) * np.clip(np.log(share) / np.log(SHARE), 0, 1)

    def __call__(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return tf
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return tf * np.where(self.hashes[k] == hashes, self.idf[k], 1.0)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, some texts at a time."""
    for batch in batches:
        for _, texts in text_slices(batch, 0, AT_ONCE):
            yield Shingled(texts.to_pylist()).hashes


def frequent(docs: DataFrame, text_col: str, documents: int) -> Weights:
    """Two passes over all documents for the shingles that at least SHARE of them hold, with exact counts."""
    least = max(2.0, SHARE * documents)
    parts = max(8, min(CELL_BLOCKS, documents // 2000))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELLS, np.int64)
        for h in _hashes(batches):
            out += np.bincount((h >> U(44)).astype(np.int64), minlength=CELLS)
        yield in_blocks(out, parts)

    texts = docs.select(text_col)
    found = summed(texts.mapInArrow(cells, BLOCK_ROWS), parts)
    full = docs.sparkSession.sparkContext.broadcast(whole(found, CELLS, parts) >= least)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for h in _hashes(batches):
            held.append(h[full.value[(h >> U(44)).astype(np.int64)]])
            size += len(held[-1])
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    exact = texts.mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = exact.where(F.col("n") >= least).toPandas()  # bounded: mean shingles a document / SHARE
    return Weights(rows["h"].to_numpy(np.int64).view(U), rows["n"].to_numpy(np.float64), documents)


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By sample and table entry: r and ln c (of Gamma(2, 1)), beta, and the ordered bits of ln a at weight 1."""
    rng = np.random.default_rng(20240229)
    shape = (BANDS * ROWS, TABLE)
    r, c, beta = rng.gamma(2, 1, shape).astype(np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape).astype(np.float32)
    r = np.maximum(r, np.float32(1e-3))
    return r, c, beta, _ordered(c + r * beta - r)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def band_keys(found: Shingled, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[text][band] keys of the weighted shingles and of the plain shingle set; a text without a word has zeros. A key names its band."""
    r, c, beta, unit = _variates()
    texts = len(found.ends)
    out, plain = np.zeros((texts, BANDS), U), np.zeros((texts, BANDS), U)
    sizes = np.diff(np.concatenate([[0], found.ends]))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out, plain
    begins = found.ends[some] - sizes[some]
    place = np.arange(len(found.hashes)).astype(U)
    odd = np.flatnonzero(weights != 1.0)
    log_w = np.log(weights[odd]).astype(np.float32)
    least = lambda a: (np.minimum.reduceat((a << U(32)) | place, begins) & U(0xFFFFFFFF)).astype(np.int64)
    for s in range(BANDS * ROWS):
        entry = (found.hashes * U(2 * s + 1) * P >> U(48)).astype(np.int64)
        a = unit[s][entry].astype(U)
        k = least(a)
        band = s // ROWS
        plain[some, band] = _mix(plain[some, band] * P + _mix(found.hashes[k]) + U(s + 1))
        step = np.zeros(len(entry), np.int64)
        if len(odd):
            odd_entry = entry[odd]
            rs, bs = r[s][odd_entry], beta[s][odd_entry]
            t = np.floor(log_w / rs + bs)
            a[odd] = _ordered(c[s][odd_entry] - rs * (t - bs) - rs)
            step[odd] = t
            k = least(a)
        out[some, band] = _mix(out[some, band] * P + _mix(found.hashes[k] + step[k].astype(U) * P) + U(s + 1))
    return out, plain


def signatures(docs: DataFrame, weights: Weights, id_col: str, text_col: str) -> DataFrame:
    """(id, key, bands): one row per document; bands, the weighted keys and those plain ones that differ, is empty where a text has no word."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("neardup", _variates.cache_clear)
        for batch in batches:
            for source, texts in text_slices(batch, size=AT_ONCE):
                found = Shingled(texts.to_pylist())
                keys, plain = band_keys(found, shared.value(found.hashes, found.tf))
                both = np.concatenate([keys, plain], axis=1)
                new = np.concatenate([np.ones(keys.shape, bool), keys != plain], axis=1) & (np.diff(np.concatenate([[0], found.ends])) > 0)[:, None]
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]), pa.int32()), pa.array(both[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([source.column(0), pa.array(found.keys, pa.binary()), bands], names=["id", "key", "bands"])

    return docs.select(id_col, text_col).mapInArrow(work, f"id {dict(docs.dtypes)[id_col]}, key binary, bands array<long>")


def _join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, group_key: str | None = None) -> DataFrame:
    """rows join groups on ``key``; groups of over 1 / HOT_SHARE of ``total`` rows, under HOT_SHARE of them, are broadcast, so that no task gets one."""
    groups = groups.withColumnRenamed(group_key or key, "__of")
    on, large = F.col(key) == F.col("__of"), F.col(count) * HOT_SHARE > total
    hot = F.broadcast(groups.where(large))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(groups.where(~large), on)).drop("__of")


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, as sorted hashes with weights, are near-duplicates."""
    na, nb = len(a[0]), len(b[0])
    wa, wb = a[1].sum(), b[1].sum()
    if not na or not nb or min(na, nb) < SIMILAR * max(na, nb) and min(wa, wb) < SIMILAR * max(wa, wb):
        return False
    k = np.minimum(np.searchsorted(a[0], b[0]), na - 1)
    common = a[0][k] == b[0]
    n = int(common.sum())
    if n >= SIMILAR * (na + nb - n):
        return True
    shared = float(np.minimum(a[1][k[common]], b[1][common]).sum())
    return shared >= SIMILAR * (wa + wb - shared) - 1e-9


def _verify(shared, first_round: bool):
    """Of a block: (id, other, failed): links found, each of which joins two components of the block, and ids that are not linked to the leader's component (failed)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["id", "side", "text"])
        found: dict[tuple[int, int], tuple] = {}
        for part, texts in text_slices(pa.RecordBatch.from_pandas(rows[["id", "side", "key", "text"]], preserve_index=False), 3, AT_ONCE):
            some = Shingled(texts.to_pylist())
            weights = shared.value(some.hashes, some.tf)
            for k, (i, side, key) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                if some.keys[k] == key:  # else another row of the same id
                    found[side, i] = (some.of(k, some.hashes), some.of(k, weights))
        links: list[tuple[int, int, bool]] = []
        root = {i: i for _, i in found}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def link(x: tuple[int, int], y: tuple[int, int]) -> None:
            if top(x[1]) != top(y[1]) and similar(found[x], found[y]):
                links.append((x[1], y[1], False))
                root[top(x[1])] = top(y[1])

        if first_round:
            ids = sorted(i for s, i in found if s == 0)
            leader = int(rows["leader"].iloc[0])
            missed = lambda i: leader not in root or top(i) != top(leader)
            for i in ids:
                if i != leader and leader in root:
                    link((0, i), (0, leader))
            for i in [i for i in ids if missed(i)]:
                for j in ids:
                    link((0, i), (0, j))
            links += [(i, leader, True) for i in ids if missed(i)]
        else:
            for x in [k for k in found if k[0] == 1]:
                for y in [k for k in found if k[0] == 0]:
                    link(x, y)
        return pd.DataFrame(links, columns=["id", "other", "failed"]).astype({"id": "int64", "other": "int64", "failed": bool})

    return work


def _with_texts(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` (id, ...) with their texts: only documents that may be among them, by a Bloom filter, are shuffled."""
    wanted = members.select("id").distinct()
    bloom, blocks = member_filter(wanted, F.col("id"), wanted.count())
    texts = maybe_repeated(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), F.col("doc"), bloom, blocks, "in").where("in").select("doc", "text")
    return members.join(texts, F.col("id") == F.col("doc")).drop("doc")


def _joined(rows: DataFrame, groups: DataFrame, key: str, group_key: str, total: int) -> DataFrame:
    """rows join groups, which have one row a key. Groups of up to SMALL rows are broadcast; beyond that only those of keys that over 1 / HOT_SHARE of
    ``rows`` have, under HOT_SHARE of them, and all others meet in a shuffle. ``total``: the number of rows. groups is a written table."""
    if groups.count() <= SMALL:
        return rows.join(F.broadcast(groups), F.col(key) == F.col(group_key)).drop(group_key)
    hot = rows.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("hot_n")).where(F.col("hot_n") * HOT_SHARE > total).select("hot_key")
    hot_groups = groups.join(F.broadcast(hot), F.col(group_key) == F.col("hot_key")).drop("hot_key")
    some = rows.join(F.broadcast(hot_groups), F.col(key) == F.col(group_key))
    rest = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left_anti").join(groups, F.col(key) == F.col(group_key))
    return some.unionByName(rest).drop(group_key)


def _followed(parents: DataFrame) -> DataFrame:
    """(v, parent) with every parent the end of its chain, by doubling: each step follows twice as many pointers."""
    total = parents.count()
    while True:
        above = parents.select(F.col("v").alias("pv"), F.col("parent").alias("pp"))
        moved = cut(_joined(parents, above, "parent", "pv", total), "parents")
        if moved.where("pp <> parent").isEmpty():
            return parents
        parents = moved.select("v", F.col("pp").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's connected component, for ids that stand in (id, other) links. Contracts until no link is left."""
    edges = cut(links.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while (total := edges.count()) > 0:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _followed(cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("parent")), "parents"))
        one = _joined(edges, parents.withColumnRenamed("parent", "pa"), "a", "v", total)
        two = _joined(one, parents.withColumnRenamed("parent", "pb"), "b", "v", total)
        edges = cut(two.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
        if roots is None:
            roots = parents.select(F.col("v").alias("id"), F.col("parent").alias("root"))
        else:
            # roots that no link is left to stay
            ends = cut(roots.select("root").distinct().join(parents, F.col("root") == F.col("v"), "left").select(F.col("root").alias("v"), F.coalesce("parent", "root").alias("parent")), "ends")
            roots = cut(_joined(roots, ends, "root", "v", roots.count()).select("id", F.col("parent").alias("root")), "roots")
    return roots if roots is not None else links.select("id", F.col("other").alias("root")).limit(0)


def _leader_blocks(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, id, key, block, blocks): the members of each leader dealt into blocks; and (leader, key, blocks)."""
    counts = cut(candidates.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.first("leader_key").alias("key")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "leaders")
    sizes = counts.select(F.col("leader").alias("of"), "blocks")
    members = _joined(candidates, sizes, "leader", "of", candidates.count())
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("leader", "id", "key", "block", "blocks")
    return dealt, counts.select("leader", "key", "blocks")


def _in_all_blocks(leaders: DataFrame) -> DataFrame:
    """Each leader's row, its text with it, in all of its blocks: dealt to salts first, so that no task makes all copies of a hot leader's text."""
    salted = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / SPAN).cast("int")))).repartition("leader", "salt")
    low = F.col("salt") * SPAN
    return salted.withColumn("block", F.explode(F.sequence(low, F.least(low + SPAN, F.col("blocks")) - 1))).drop("salt")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest id of the class), kept (whether it is that one).

    A null text counts as empty; texts without a word are in one class only where they are equal. Ids are integers and meant to be
    unique: repeated rows share a class, and a row of a null id is in the class of the texts with its words (null where no other has an id).
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    documents = docs.count()
    weights = frequent(docs, text_col, documents)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    signed = cut(signatures(docs, weights, id_col, text_col), "signatures")
    named = cut(signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "representatives")

    keyed = named.where("id IS NOT NULL")
    total = keyed.agg(F.sum(F.size("bands"))).first()[0] or 0
    buckets = keyed.select("id", "key", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("id", "key")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = _join_groups(buckets, leaders, "bucket", "m", total).where("id <> lead.id")
    candidates = cut(met.select("id", "key", F.col("lead.id").alias("leader"), F.col("lead.key").alias("leader_key")).distinct(), "candidates")

    members, heads = _leader_blocks(candidates)
    blocks = cut(members, "blocks")
    schema = "id long, other long, failed boolean"

    def texts_of(members: DataFrame) -> DataFrame:
        return _with_texts(members, docs, id_col, text_col)

    def verified(rows: DataFrame, by: list[str | Column], first_round: bool) -> DataFrame:
        return cut(rows.withColumn("side", F.col("side").cast("int")).groupBy(*by).applyInPandas(_verify(shared, first_round), schema), "verified")

    copies = _in_all_blocks(texts_of(heads.withColumn("id", F.col("leader"))))
    first = verified(texts_of(blocks).unionByName(copies).withColumn("side", F.lit(0)), ["leader", "block"], True)
    links = first.where("NOT failed").select("id", "other")

    # ids that failed in a leader's group of several blocks meet that group's other blocks as well
    failed = first.where("failed").select("id", F.col("other").alias("leader")).distinct().join(blocks.where("blocks > 1"), ["leader", "id"])
    failed = cut(failed, "failed") if not first.where("failed").isEmpty() else None
    if failed is not None and not failed.isEmpty():
        deal = failed.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("deals")).withColumnRenamed("leader", "fl")
        asked = failed.join(deal, F.col("leader") == F.col("fl")).withColumn("deal", F.pmod(F.xxhash64("id", F.lit(1)), F.col("deals")).cast("int"))
        probes = asked.select("leader", "id", "key", "deal", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("own <> block").select("leader", "id", "key", "deal", "block", F.lit(1).alias("side"))
        others = blocks.join(deal, F.col("leader") == F.col("fl")).select("leader", "id", "key", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "block", F.lit(0).alias("side"))
        links = links.unionByName(verified(texts_of(probes.unionByName(others)), ["leader", "deal", "block"], False).select("id", "other"))

    roots = components(links).withColumnRenamed("id", "rid")
    roots = F.broadcast(roots) if roots.count() <= SMALL else roots
    by_key = named.join(roots, F.col("id") == F.col("rid"), "left").select("key", "n", F.coalesce("root", "id").alias("class_id"))
    out = _join_groups(signed.select("id", "key"), by_key, "key", "n", documents)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that classes() keeps, with all their columns, whatever their names and types. Rows that surely stay are not shuffled.

    Repeated rows of an id that stays all stay, and rows of a null id always do, as nothing tells one from another; an empty table gives an empty result.
    """
    gone_id, maybe = fresh(docs, "gone"), fresh(docs, "maybe")
    gone = cut(classes(docs, id_col, text_col).where(F.col(id_col).isNotNull() & ~F.col("kept")).select(F.col(id_col).alias(gone_id)).distinct(), "gone")
    bloom, blocks = member_filter(gone, F.col(gone_id), gone.count())
    probed = maybe_repeated(docs, F.col(f"`{id_col}`").cast("long"), bloom, blocks, maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unsure = F.col(maybe) & F.col(f"`{id_col}`").isNotNull()
    stay = probed.where(~unsure).select(*columns)
    return stay.unionByName(probed.where(unsure).join(gone, F.col(f"`{id_col}`").cast("long") == F.col(gone_id), "left_anti").select(*columns))
