"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``SIZE`` tokens: full pieces, then the rest. The pieces' lengths are counted, and
the packing is worked out on that histogram alone (at most SIZE numbers, whatever the input): lengths are placed longest first,
each into the shortest pack that it fits, by updating the counts of packing patterns. Patterns are joined back to the pieces by rank:
a piece's rank among those of its length is its rank within its task plus what earlier tasks hold, so no task sees all of a length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.bpe import WS, Chunks, joined
from inkwell.llm.common import cut, own_worker, text_slices

SIZE = 2048
END = 1
# Python's split() also parts at these; the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(f"[{WS}]+")


# The tokenizer's own pattern, and the mark of a word's last token.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
LAST = "</w>"
#: Not to be lower-cased and parted here: what normalisation may change by more than case, special tokens, and what parts only in Python.
ODD = "[^\x00-\x1b\x20-\u012f\u0131-\u02ff]|<\\|"
#: A full stop or comma beside another mark: such marks are one word to the tokenizer.
BESIDE = r"[.,][^\pL\pN\s]|[^\pL\pN\s][.,]"
JOINED, CALL = 256, 16
#: Parts that a worker keeps; when full, its cache starts anew.
PARTS = 160_000


class Words:
    """The tokenizers library behind a cache: texts are parted into words, and new words go to the library, many to a call."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(LAST)]] = True
        self.odd = re.compile(ODD)
        self.words, self.chunks = Chunks(self._learn, PARTS), Chunks(self._encode, PARTS)

    def clear(self) -> None:
        self.words.clear()
        self.chunks.clear()

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words, lower-case and of one pre-token each; joined, JOINED of them to a text and CALL texts to a call, and parted at each word's last token."""
        ids, sizes = [], []
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        calls = (groups[k : k + CALL] for k in range(0, len(groups), CALL))
        encodings = (e for call in calls for e in self.tokenizer.encode_batch_fast([" ".join(g) for g in call], add_special_tokens=False))
        for some, encoding in zip(groups, encodings, strict=True):
            found = np.array(encoding.ids, np.int32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(some) and ends[-1] == len(found):
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [self._one(w) for w in some]
                ids.append(np.array([i for x in each for i in x], np.int32))
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, mixed, flat, counts, whole = [], [], [], [], []
        for k, p in enumerate(parts):
            if p.isalpha() and p.isascii() and p.islower():
                plain.append(k)
            elif self.odd.search(p) is None:
                low = p.lower()
                found = [low] if low.isalpha() else PATTERN.findall(low)
                mixed.append(k)
                counts.append(len(found))
                flat += found
            else:
                whole.append(k)
        sizes = np.zeros(len(parts), np.int64)
        own, sizes[plain] = self._learn([parts[k] for k in plain])
        ids, n = self.words.of(flat)
        ends, totals = np.cumsum(np.array(counts, np.int64)), np.concatenate([[0], np.cumsum(n)])
        sizes[mixed] = totals[ends] - totals[ends - np.array(counts, np.int64)]
        each = [self._one(parts[k]) for k in whole]
        sizes[whole] = [len(x) for x in each]
        of = lambda places: np.array(places, np.int64)
        return joined(sizes, [(of(plain), own), (of(mixed), ids), (of(whole), np.array([i for x in each for i in x], np.int32))]), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and where each one ends.

        This tokenizer drops white space and case and merges nothing across white space, nor a full stop or comma that stands by itself
        with what is around it: words with and without those are one part, so there are fewer parts to learn.
        """
        odd = pc.match_substring_regex(texts, ODD)
        low = pc.utf8_lower(texts)
        apart = pc.replace_substring(pc.replace_substring(low, ".", " . "), ",", " , ")
        parts = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(low, BESIDE), low, apart))
        if pc.any(odd).as_py():
            own = [_parts(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            parts = pc.if_else(odd, pa.array(own, parts.type), parts)
        return self.chunks.ids(parts)


def _parts(text: str) -> list[str]:
    if SEPARATORS.search(text) is None:
        return text.split()
    return [x for x in SPACE.split(text) if x]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, rank): the pieces of every document, with the task's number and the piece's rank, from 0, among those of its length in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _tokenizer(path), TaskContext.get().partitionId()
        own_worker("packing", words.clear)
        seen = np.zeros(size + 1, np.int64)
        end_id = np.array([END], "<u4").tobytes()
        for batch in batches:
            for source, texts in text_slices(batch):
                rows: list[tuple[int, int, int, int, int, int]] = []
                ids, ends = words.encode(texts)
                raw, a = ids.astype("<u4").tobytes(), 0
                for k, b in enumerate(ends.tolist()):
                    total, own = b - a + 1, raw[4 * a : 4 * b] + end_id
                    for start in range(0, total, size):
                        n = min(size, total - start)
                        rows.append((k, start, n, zlib.crc32(own[4 * start : 4 * (start + n)]), total, int(seen[n])))
                        seen[n] += 1
                    a = b
                columns = list(zip(*rows, strict=True))
                others = [pa.array(c, pa.int64()) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays([source.column(0).take(pa.array(columns[0], pa.int64())), *others[:4], pa.array([part] * len(rows), pa.int32()), others[4]], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with counts. Lengths are placed longest first, each into the shortest pack with room for it, else into a new one."""
    open_: dict[int, list[list]] = defaultdict(list)  # used length -> [pattern, count]
    shortest: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(used: int, pattern: tuple[int, ...], count: int) -> None:
        if used == size:
            done.append((pattern, count))
            return
        if not open_[used]:
            heapq.heappush(shortest, used)
        open_[used].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and shortest and shortest[0] + length <= size:
            used = shortest[0]
            pattern, count = open_[used][-1]
            taken = min(left, count)
            left -= taken
            if taken == count:
                open_[used].pop()
                if not open_[used]:
                    heapq.heappop(shortest)
            else:
                open_[used][-1][1] -= taken
            # one piece each: what has grown is open again at once, as it may be the shortest still
            add(used + length, (*pattern, length), taken)
        if left:
            per = max(1, size // length)
            # a new pack is the shortest there is until it has no room left: whole packs of this length at once
            if left // per:
                add(per * length, (length,) * per, left // per)
            if left % per:
                add(left % per * length, (length,) * (left % per), 1)
    done += [(tuple(p), n) for packs in open_.values() for p, n in packs]
    return done


def _places(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: ranks at which runs begin, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            runs[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def packed(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end token alone. Repeated rows and null ids are documents of their own; other columns, whatever their
    names, are ignored; an empty table gives an empty result.
    """
    cut_up = cut(pieces(docs, path, size, id_col, text_col), "pieces")
    counts = cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places = docs.sparkSession.sparkContext.broadcast(_places(patterns(histogram, size)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, firsts = np.unique(length[order], return_index=True)
            for value, at in zip(values.tolist(), np.split(order, firsts[1:]), strict=True):
                begins, sequences, offsets = places.value[value]
                k = np.searchsorted(begins, rank[at], side="right") - 1
                sequence[at], offset[at] = sequences[k] + rank[at] - begins[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ranked = cut_up.join(before, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length"))).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
