"""Phrase collocations from counts of weighted n-grams.

1. Texts become pieces; identical pieces of a language become one with a multiplicity, in the worker and then by a sum in Spark.
2. Words and word pairs are counted: each worker sums those of a unit of pieces (``UNIT`` bytes) and sends them in blocks, one for each hash bucket. The task of
   a bucket counts them out-of-core in duckdb, which reads the blocks one after another and has ``MEMORY`` to itself before it spills. Only n-grams of ``least``
   occurrences or more are kept: all parts of a candidate are among them.
3. Word triples follow likewise, but only where both pairs may be frequent: a Bloom filter of the frequent pairs, of a fixed size, tells. Where more pairs are
   frequent than it can hold, more triples are counted; the result is the same.
4. A candidate's parts lie in other buckets. Each candidate sends a lookup request for every part, shuffled to where the part's count is. Parts in over a
   thousandth of all words, some thousands at most, are broadcast instead, so no part draws a large share of the requests.
5. Scores are exact integers of up to 38 digits. A pair inside triples asks for the most frequent of them likewise. The first of each language are found
   by salted, then by whole ranks.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, own_worker, text_slices

#: Bytes of pieces that a worker counts at once; n-grams of a bucket before they are summed, about; memory of duckdb in a task; bits of the Bloom filter (16 MB); hot: over 1 in so many words.
UNIT, BUCKET, MEMORY, BITS, HOT_SHARE = 6 << 20, 1 << 21, "256MB", 1 << 27, 1000
BLOCK_BITS = 32_768
#: Fixed values of the contract: what parts pieces, and what parts words.
PIECE_ENDS, WORD_ENDS = "[.,;:!?\n\x0b\x0c\r]+", "[ \t]+"
GRAMS = pa.schema([("lang", pa.large_binary()), ("gram", pa.large_binary()), ("f", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, their words joined by one space, and how often they occur."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations", lambda: None)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                whole = pc.replace_substring_regex(pc.ascii_lower(texts), PIECE_ENDS, "\n")
                split = pc.split_pattern(whole, "\n")
                flat = pc.ascii_trim(pc.replace_substring_regex(split.flatten(), WORD_ENDS, " "), characters=" ")
                lang = pc.take(pc.fill_null(part.column(0), "und"), pc.list_parent_indices(split))
                found = pa.table([lang, flat], ["lang", "piece"]).filter(pc.greater(pc.binary_length(flat), 0))
                found = found.group_by(["lang", "piece"]).aggregate([([], "count_all")])
                for b in found.cast(pa.schema([("lang", pa.string()), ("piece", pa.string()), ("count_all", pa.int64())])).to_batches(65_536):
                    yield pa.RecordBatch.from_arrays(b.columns, ["lang", "piece", "m"])

    return docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(strings: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, strings.to_pylist()), np.uint64, len(strings))


def _sums(keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct keys: the place of one of each and the sum of its weights; and for every place the number of its key."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    starts, number = np.flatnonzero(new), np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[starts], np.add.reduceat(m[order], starts) if len(starts) else np.zeros(0, np.int64), number


class _Unit:
    """The words of some pieces: at each place the word's code, the language's code, the multiplicity, and how many words follow in its piece."""

    def __init__(self, lang: pa.Array, piece: pa.Array, m: np.ndarray) -> None:
        split = pc.split_pattern(piece.cast(pa.large_string()), " ")
        words = split.flatten().cast(pa.large_binary()).dictionary_encode()
        langs = lang.cast(pa.large_binary()).dictionary_encode()
        self.vocabulary, self.languages = words.dictionary, langs.dictionary
        self.hashes, self.lang_hashes = _hashes(words.dictionary), _mixed(_hashes(langs.dictionary))
        of, sizes = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.word, self.lang, self.m = words.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)[of], m[of]
        self.after = (np.cumsum(sizes)[of] if len(of) else of) - np.arange(len(of)) - 1
        self.n = (np.bincount(langs.indices.to_numpy(), weights=m * sizes, minlength=len(langs.dictionary))).astype(np.int64)
        # numbers of the distinct words of a language, and of its pairs at each place that has one
        self.one, self.one_sum, self.one_at = _sums(self.lang * len(self.vocabulary) + self.word, self.m)
        self.pairs = np.flatnonzero(self.after >= 1)
        self.two, self.two_sum, self.two_at = _sums(self.one_at[self.pairs] * len(self.vocabulary) + self.word[self.pairs + 1], self.m[self.pairs])

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the n-grams of ``size`` words at places ``at``: the same in every unit."""
        h = self.lang_hashes[self.lang[at]] + np.uint64(size)
        for k in range(size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ self.hashes[self.word[at + k]])
        return h

    def grams(self, at: np.ndarray, size: int, f: np.ndarray) -> pa.RecordBatch:
        words = [self.vocabulary.take(pa.array(self.word[at + k])) for k in range(size)]
        return pa.RecordBatch.from_arrays([self.languages.take(pa.array(self.lang[at])), words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())), pa.array(f)], schema=GRAMS)

    def empty(self) -> pa.RecordBatch:
        """The empty phrase of each language: its count is that of all words."""
        return pa.RecordBatch.from_arrays([self.languages, pa.array([b""] * len(self.n), pa.large_binary()), pa.array(self.n)], schema=GRAMS)

    def triples(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the distinct triples both pairs of which may be frequent."""
        may = _has(bits, self.hash(self.pairs[self.two], 2))
        pair = np.full(len(self.word), -1, np.int64)
        pair[self.pairs] = np.where(may[self.two_at], self.two_at, -1)
        at = np.flatnonzero(self.after >= 2)
        at = at[(pair[at] >= 0) & (pair[at + 1] >= 0)]
        first, sums, _ = _sums(pair[at] * len(self.vocabulary) + self.word[at + 2], self.m[at])
        return at[first], sums


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in (h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)):
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _blocks(found: list[tuple[pa.RecordBatch, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block): the n-grams of a unit by hash bucket, each block a compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    grams = pa.Table.from_batches([g for g, _ in found], GRAMS).combine_chunks()
    bucket = (np.concatenate([h for _, h in found]) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    grams, ends = grams.take(pa.array(order)).combine_chunks(), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    for k in range(buckets):
        if ends[k] < ends[k + 1]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, GRAMS, options=options) as writer:
                writer.write_table(grams.slice(ends[k], ends[k + 1] - ends[k]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block"])


def _units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Unit]:
    """Batches (lang, piece, m) in units of about ``most`` bytes."""
    held, size = [], 0

    def made() -> _Unit:
        t = pa.Table.from_batches(held).combine_chunks()
        return _Unit(t.column(0).chunk(0), t.column(1).chunk(0), t.column(2).to_numpy())

    for batch in batches:
        for part, texts in text_slices(batch, 1, most):
            if not part.num_rows:
                continue
            n = pc.sum(pc.binary_length(texts)).as_py() or 0
            if held and size + n > most:
                yield made()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield made()


def counted(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """(lang, gram, f) of the n-grams that occur ``least`` times or more, counted by bucket in duckdb."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        own_worker("collocations", lambda: None)
        read = (b for batch in batches for block in batch.column(1) for b in pa.ipc.open_stream(block.as_buffer()))
        if (first := next(read, None)) is None:
            return
        own = tempfile.mkdtemp(prefix="inkwell-count-")  # what a task spills; gone with the task
        try:
            with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": os.path.join(own, "spill"), "preserve_insertion_order": False}) as db:
                reader = pa.RecordBatchReader.from_batches(GRAMS, (b for part in ([first], read) for b in part))
                db.register("grams", reader)
                found = db.sql(f"SELECT lang, gram, sum(f)::BIGINT AS f FROM grams GROUP BY lang, gram HAVING sum(f) >= {int(least)}").to_arrow_reader(65_536)
                for b in found:
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()).cast(pa.string()), b.column(1).cast(pa.binary()).cast(pa.string()), b.column(2)], ["lang", "gram", "f"])
        finally:
            shutil.rmtree(own, True)

    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(work, "lang string, gram string, f long")


def ngram_counts(found: DataFrame, least: int) -> DataFrame:
    """(lang, gram, f, size) of the n-grams of up to three words in ``pieces`` that occur ``least`` times or more, and as size 0 the number of all words."""
    places = found.agg(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    buckets, unit = max(1, -(-places // BUCKET)), UNIT

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations", lambda: None)
        for u in _units(batches, unit):
            one, two = u.one, u.pairs[u.two]
            yield from _blocks([(u.empty(), u.lang_hashes), (u.grams(one, 1, u.one_sum), u.hash(one, 1)), (u.grams(two, 2, u.two_sum), u.hash(two, 2))], buckets)

    n_words = F.when(F.col("gram") == "", 0).otherwise(F.size(F.split("gram", " ")))
    few = cut(counted(found.mapInArrow(short, "bucket int, block binary"), buckets, least).withColumn("size", n_words), "grams")
    bits = found.sparkSession.sparkContext.broadcast(_filter(few.where("size = 2")))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations", lambda: None)
        for u in _units(batches, unit):
            at, f = u.triples(bits.value)
            if len(at):
                yield from _blocks([(u.grams(at, 3, f), u.hash(at, 3))], buckets)

    return few.unionByName(cut(counted(found.mapInArrow(long, "bucket int, block binary"), buckets, least).withColumn("size", F.lit(3)), "triples"))


def _filter(pairs: DataFrame) -> np.ndarray:
    """The Bloom filter of word pairs: BITS bits, whatever their number. Bitmaps are made by Spark, by blocks of bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _Unit(batch.column(0), batch.column(1), np.ones(batch.num_rows, np.int64))
                h = u.hash(u.pairs[u.two], 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)])).astype(np.int64))], ["bit"])

    bits = np.zeros(BITS // 8, np.uint8)
    slots = pairs.select("lang", "gram").mapInArrow(work, "bit long")
    made = slots.groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % BLOCK_BITS).alias("bits"))
    for row in made.toLocalIterator():  # BITS / BLOCK_BITS rows of 4 KB at most
        bits[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _looked_up(requests: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """requests (lang, part, ...) with f, the count of the part: hot parts broadcast, the others shuffled to their counts."""
    known = counts.select(F.col("lang").alias("part_lang"), F.col("gram").alias("part_gram"), "f")
    hot, on = F.col("f") * HOT_SHARE >= total, (F.col("lang") == F.col("part_lang")) & (F.col("part") == F.col("part_gram"))
    often = F.broadcast(known.where(hot))
    some = requests.join(often, on).unionByName(requests.join(often, on, "left_anti").join(known.where(~hot), on))
    return some.drop("part_lang", "part_gram")


def _part(first: int, size: int) -> Column:
    """Words first, ... of the phrase."""
    return F.array_join(F.slice("w", first, size), " ")


def score() -> Column:
    """floor(1,000,000 a a / (l r)) of the columns a, l and r, which are under 10 ** 15: exact in decimals of 38 digits."""
    return F.expr("CAST(1000000 * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is a candidate from ``least`` occurrences on. Its score is floor(1,000,000 a a / (l r)) at the cut into two parts where that is least, at the
    first such cut; a pair within a candidate of three words that has ``inside`` per cent of its occurrences or more is dropped. Ties in the score go to the larger
    a, then to the phrase that is first in the order of bytes. Null texts count as empty, a null language as und; a text without words gives nothing.
    Repeated rows count as often as they stand; ids and other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    found = cut(pieces(docs, text_col, lang_col), "pieces")
    counts = ngram_counts(found, least)
    total = counts.where("size = 0").agg(F.sum("f")).first()[0] or 0
    parts, candidates = counts.where("size BETWEEN 1 AND 2"), counts.where("size >= 2").withColumn("w", F.split("gram", " "))
    cuts = F.array(*(F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), _part(1, k).alias("l"), F.array_join(F.slice("w", F.lit(k + 1), F.col("size") - k), " ").alias("r"))) for k in (1, 2)))
    cuts = candidates.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c"))
    requests = cuts.select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("c.l").alias("part")), F.struct(F.lit(False).alias("left"), F.col("c.r").alias("part")))).alias("x")).select("lang", "phrase", "a", "k", "x.left", "x.part")
    sides = _looked_up(requests, parts, total).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    scored = sides.withColumn("score", score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    longer = candidates.where("size = 3").select("lang", F.col("f").alias("more"), F.explode(F.array(_part(1, 2), _part(2, 2))).alias("inner")).groupBy(F.col("lang").alias("in_lang"), "inner").agg(F.max("more").alias("more"))
    kept = scored.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left").where(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * inside))
    kept = cut(kept.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score")), "scored")
    salts = max(1, round((kept.count() / first) ** 0.5)) if first else 1
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    n = F.broadcast(counts.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))) if total else counts.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return best.join(n, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
