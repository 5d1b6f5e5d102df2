"""Lines that many documents share, dropped by a sharded minimal perfect hash.

1. Counting: each worker reduces the lines of a slice of texts to 128-bit hashes, each once for a document, and sums equal ones; Spark sums the rest by hash.
   A line found in one document only is left out of the index: a fingerprint tells it apart from those that are in it.
2. Index: the distinct hashes are dealt to shards of about ``SHARD`` keys. A shard's task makes a minimal perfect hash (levels of bits: a key belongs to the
   first level where it meets no other) and, in its order, an array of 64-bit fingerprints and one of counts. A shard is one row of the index's file.
3. Probing: documents probe the arrays; lines are never joined with lines. An index of up to ``HELD`` bytes goes to every worker. A larger one stays where
   it is: each slice of texts sends every hash once, as a request to the task of its shard, which streams requests past the arrays of one shard at a time; what
   comes back are the hashes to drop. Hashes in over a thousandth of all documents' lines, at most a thousand, are known to every worker and never requested.

A line's hash stands for the line: 64 bits of it find the shard and the place, the other 64 are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, fresh, own_worker, text_slices

#: Keys of a shard; tasks that make shards or answer requests, at most; bytes of an index that goes to every worker; bits of a level for each of its keys; hot:
#: over one in so many of all lines of all documents, so that as many keys are hot at most.
SHARD, TASKS, HELD, GAMMA, HOT_SHARE = 1 << 13, 10_000, 32 << 20, 2.0, 1000
#: Fixed values of the contract: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
INDEX = "shard int, keys int, sizes binary, bits binary, ranks binary, prints binary, counts binary, width int"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit positions of keys in a level. Both halves count, so distinct keys part ways sooner or later."""
    seed = _mixed(np.array([2 * level + 1, 2 * level + 2], np.uint64))
    return _mixed(hi * (seed[0] | np.uint64(1)) ^ _mixed(lo + seed[1])) % np.uint64(size)


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(hi) % np.uint64(shards)).astype(np.int32)


class Shard:
    """A minimal perfect hash of distinct 128-bit keys, with a fingerprint and a count at each key's place."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks, self.prints, self.counts = sizes, bits, ranks, prints, counts

    @classmethod
    def made(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> Shard:
        """Of distinct keys."""
        sizes, levels, left, order = [], [], np.arange(len(hi)), []
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(hi[left], lo[left], len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            own = alone[at.astype(np.int64)]
            order.append(left[own][np.argsort(at[own])])
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~own]
        bits = np.concatenate([np.zeros(0, np.uint8), *levels])
        words = bits.view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
        at = np.concatenate([np.zeros(0, np.int64), *order])
        return cls(np.array(sizes, np.int64), bits, ranks, lo[at], counts[at].astype(np.min_scalar_type(int(counts.max(initial=0)))))

    def row(self, shard: int) -> dict:
        return {"shard": shard, "keys": len(self.prints), "sizes": self.sizes.astype("<i8").tobytes(), "bits": self.bits.tobytes(), "ranks": self.ranks.astype("<u4").tobytes(), "prints": self.prints.astype("<u8").tobytes(), "counts": self.counts.tobytes(), "width": self.counts.dtype.itemsize}

    @classmethod
    def read(cls, row: dict) -> Shard:
        return cls(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], "<u4"), np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], f"<u{row['width']}"))

    def found(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The counts of keys; 0 for one that is not here."""
        out, left, base = np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes.tolist()):
            bit = _place(hi[left], lo[left], level, size) + np.uint64(base)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            here = (words[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(words[word[here]] & ((np.uint64(1) << shift[here]) - np.uint64(1)))
            place, of = self.ranks[word[here]].astype(np.int64) + below, left[here]
            same = self.prints[place] == lo[of]
            out[of[same]] = self.counts[place[same]]
            left, base = left[~here], base + size
            if not len(left):
                break
        return out


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: all lines, the row of each, both halves of its key's hash, and which keys are not empty."""
    from xxhash import xxh3_128_digest

    # texts reach 2 GB, lines of several may be more
    parts = pc.split_pattern(texts, "\n")
    lines, rows = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS)).cast(pa.large_binary())
    full = pc.binary_length(keys).to_numpy(zero_copy_only=False) > 0
    halves = np.frombuffer(b"".join(map(xxh3_128_digest, keys.to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
    return lines, rows, halves[:, 0], halves[:, 1], full


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The places of the first of equal rows, in the columns' order."""
    order = np.lexsort(columns[::-1])
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order[new]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hi, lo, n): the hash of each distinct key of the lines of ``docs`` and the number of rows that it is found in. Empty keys are none; null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                _, rows, hi, lo, full = _lines(texts)
                rows, hi, lo = rows[full], hi[full], lo[full]
                once = _distinct(hi, lo, rows)
                hi, lo = hi[once], lo[once]
                if not len(hi):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
                yield pa.RecordBatch.from_arrays([_long(hi[starts]), _long(lo[starts]), pa.array(np.diff(np.append(starts, len(hi))))], ["hi", "lo", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def index(counts: DataFrame, least: int = 2) -> tuple[DataFrame, int, DataFrame]:
    """The index of the keys of ``counts`` found in ``least`` rows or more: its file, the number of shards, and the hot keys (at most HOT_SHARE)."""
    counts = cut(counts, "lines")
    total = counts.agg(F.sum("n"), F.sum((F.col("n") >= least).cast("int"))).first()
    pairs, keys = total[0] or 0, total[1] or 0
    shards = max(1, -(-keys // SHARD))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        of, parts = None, []

        def made() -> pa.RecordBatch:
            hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = Shard.made(hi, lo, n).row(of)
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c, pa.binary() if isinstance(v, bytes) else pa.int32()) for c, v in row.items()]))

        for batch in batches:
            shard = batch.column(0).to_numpy()
            hi, lo, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            for run in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if len(run):
                    if parts and shard[run[0]] != of:
                        yield made()
                        parts = []
                    of = int(shard[run[0]])
                    parts.append((hi[run].view(np.uint64), lo[run].view(np.uint64), n[run]))
        if parts:
            yield made()

    dealt = counts.where(F.col("n") >= least).select(_shard(shards).alias("shard"), "hi", "lo", "n")
    file = cut(dealt.repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard").mapInArrow(work, INDEX), "index")
    return file, shards, counts.where(F.col("n") * HOT_SHARE > pairs)


def _shard(shards: int):
    """shard_of() of the column hi."""

    @F.arrow_udf("int")
    def of(hi: pa.Array) -> pa.Array:
        return pa.array(shard_of(hi.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), shards))

    return of("hi")


class _Held:
    """All shards of a small index."""

    def __init__(self, rows: list[dict], shards: int) -> None:
        self.shards, self.of = shards, {r["shard"]: Shard.read(r) for r in rows}

    def found(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(hi), np.int64), shard_of(hi, self.shards)
        for s, own in self.of.items():
            at = np.flatnonzero(shard == s)
            out[at] = own.found(hi[at], lo[at])
        return out


def _without(texts: pa.Array, lines: pa.Array, rows: np.ndarray, drop: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the dropped lines, the number of lines and of dropped ones."""
    n = np.bincount(rows, minlength=len(texts))
    gone = np.bincount(rows[drop], minlength=len(texts))
    kept = lines.filter(pa.array(~drop))
    ends = np.concatenate([[0], np.cumsum(n - gone)])
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept), "\n")
    return joined, n, gone


def _probed(docs: DataFrame, file: DataFrame, shards: int, least: int, text_col: str, names: tuple[str, str]) -> DataFrame:
    """With the index in every worker: HELD bytes at most."""
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in file.collect()])
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        index = _Held(held.value, shards)
        for batch in batches:
            for part, texts in text_slices(batch, at):
                lines, rows, hi, lo, full = _lines(texts)
                yield _row(part, at, *_without(texts, lines, rows, full & (index.found(hi, lo) >= least)))

    return _over(docs, work, names)


def _row(part: pa.RecordBatch, at: int, joined: pa.Array, n: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    nulls = part.column(at).is_null()
    text = pc.if_else(pc.and_(nulls, pa.array(gone == 0)), pa.scalar(None, joined.type), joined)
    columns = [text.cast(part.column(at).type) if k == at else part.column(k) for k in range(part.num_columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [f"c{k}" for k in range(part.num_columns + 2)])


def _over(docs: DataFrame, work, names: tuple[str, str]) -> DataFrame:
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = plain.withColumns({f"c{len(docs.columns)}": F.lit(0).cast("long"), f"c{len(docs.columns) + 1}": F.lit(0).cast("long")}).schema
    return plain.mapInArrow(work, schema).toDF(*docs.columns, *names)


def _requested(docs: DataFrame, file: DataFrame, shards: int, hot: DataFrame, least: int, text_col: str, names: tuple[str, str]) -> DataFrame:
    """With the index in its file: hashes go to the shards, those to drop come back to their rows."""
    row, gone = fresh(docs, "row", "drop"), fresh(docs, "drop", "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = [(r.hi, r.lo, r.n) for r in hot.collect()]  # HOT_SHARE at most
    low = np.array([x[1] for x in known], np.int64)
    often = docs.sparkSession.sparkContext.broadcast((np.sort(low), np.sort(low[[x[2] >= least for x in known]]) if known else low))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                _, rows, hi, lo, full = _lines(texts)
                full &= ~np.isin(lo.view(np.int64), often.value[0])
                rows, hi, lo = rows[full], hi[full], lo[full]
                once = _distinct(hi, lo, rows)
                rows, hi, lo = part.column(0).to_numpy()[rows[once]], hi[once], lo[once]
                if not len(hi):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
                who = pa.ListArray.from_arrays(pa.array(np.append(starts, len(hi)), pa.int32()), pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(hi[starts], shards)), _long(hi[starts]), _long(lo[starts]), who], ["shard", "hi", "lo", "who"])

    requests = numbered.select(row, F.col(f"`{text_col}`").alias("text")).mapInArrow(asked, "shard int, hi long, lo long, who array<long>")
    arrays = file.select("shard", F.struct(*file.columns).alias("own"))
    # the arrays of a shard come first, then its requests
    dealt = requests.unionByName(arrays, allowMissingColumns=True).repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", F.col("hi").asc_nulls_first())

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        of, own = None, None
        for batch in batches:
            shard, arrays = batch.column(0).to_numpy(), pc.is_valid(batch.column(4)).to_numpy(zero_copy_only=False)
            for run in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if not len(run):
                    continue
                if arrays[run[0]]:
                    of, own, run = int(shard[run[0]]), Shard.read(batch.column(4)[int(run[0])].as_py()), run[1:]
                if not len(run) or shard[run[0]] != of:
                    continue  # the arrays alone, or a shard without keys
                hi, lo = (batch.column(k).take(pa.array(run)).to_numpy().astype(np.int64) for k in (1, 2))
                drop = own.found(hi.view(np.uint64), lo.view(np.uint64)) >= least
                if drop.any():
                    who = batch.column(3).take(pa.array(run[drop]))
                    yield pa.RecordBatch.from_arrays([who.flatten(), pa.array(np.repeat(lo[drop], pc.list_value_length(who).to_numpy()))], ["row", "lo"])

    drops = dealt.mapInArrow(probed, "row long, lo long").groupBy("row").agg(F.collect_list("lo").alias(gone)).withColumnRenamed("row", "of_row")
    joined = numbered.join(drops, F.col(row) == F.col("of_row"), "left").drop("of_row", row)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("linededup", lambda: None)
        for batch in batches:
            for part, texts in text_slices(batch, at):
                lines, rows, _, lo, full = _lines(texts)
                lists = part.column(part.num_columns - 1)
                whose = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.rec.fromarrays([whose, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])
                mine = np.rec.fromarrays([rows, lo.view(np.int64)])
                drop = full & (np.isin(lo.view(np.int64), often.value[1]) | np.isin(mine, pairs))
                yield _row(part.drop_columns([part.schema.names[-1]]), at, *_without(texts, lines, rows, drop))

    plain = joined.toDF(*(f"c{k}" for k in range(len(docs.columns) + 1)))
    schema = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumns({f"c{len(docs.columns)}": F.lit(0).cast("long"), f"c{len(docs.columns) + 1}": F.lit(0).cast("long")}).schema
    return plain.mapInArrow(work, schema).toDF(*docs.columns, *names)


def drop_repeated_lines(docs: DataFrame, least: int = 10, text_col: str = "text", held: int = HELD) -> DataFrame:
    """``docs`` without the lines whose keys are found in ``least`` rows or more (2 at least), and with n_lines (before) and n_dropped.

    A line ends at a newline; its key is the line without blanks at both ends and with A-Z in lower case. Lines with an empty key always stay. Every row counts as
    a document of its own, repeated rows and null ids too. Null and empty texts have one empty line and come back as they are; a text that loses all its
    lines becomes empty. Other columns stay, whatever their names (n_lines_ or n_dropped_ where the plain name is taken). An empty table gives an empty result.
    An index of over ``held`` bytes is probed by requests.
    """
    if least < 2:
        raise ValueError("least: 2 at least")
    file, shards, hot = index(line_counts(docs, text_col))
    names = fresh(docs, "n_lines", "n_dropped"), fresh(docs, "n_dropped", "n_lines")
    size = file.agg(F.sum(sum((F.length(c) for c, kind in file.dtypes if kind == "binary"), F.lit(0)))).first()[0] or 0
    if size <= held:
        return _probed(docs, file, shards, least, text_col, names)
    return _requested(docs, file, shards, hot, least, text_col, names)


def line_digests(docs: DataFrame, least: int = 10, held: int = HELD) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of drop_repeated_lines(); what it says of odd input holds."""
    found = drop_repeated_lines(docs.select("doc_id", "text"), least, "text", held)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
