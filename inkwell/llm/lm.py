"""Language-model scoring with a hashed maximum-entropy model.

1. Documents become units: numbered word arrays of about ``HELD`` tokens with their distinct words as 64-bit hashes. Units are written
   once; nothing is tokenised again.
2. Word counts: each unit's distinct words go by hash range to the task that adds them up, and the sums go back to the units, so no task and not the
   driver holds the vocabulary. Ranges are as many as the words' volume asks for, ``RANGE_BYTES`` each.
3. Words fall into leaves: each of the ``FREQUENT`` most frequent words is one, all others share ``ENDINGS`` leaves by their hashed ending. Leaves are clustered
   by their neighbours into ``CLASSES`` of at most ``WIDTH``, and the model is
   P(word | history) = P(class | history) P(leaf | class, history) P(word | leaf).
   The first two factors are softmaxes over hashed features of the history: the previous word, the previous two, and for classes skips over one and over two
   words as well. The last is 1 for a leaf of one word; in a shared leaf the word itself is its only feature, for which the weights of greatest entropy are, in closed form, the logs of
   the relative frequencies. All new words of a leaf are one symbol there, as in the base score.
4. Training is distributed: every task makes Adagrad steps over its units, from the common start, and the weights are averaged by the tokens that each task has seen.
   Sums stream through ``BLOCKS`` tasks at most, so none holds more than its own part of the weights.
5. Units are scored in numpy batches that touch only the weights of the features at hand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import BLOCK_ROWS, cut, in_blocks, own_worker, summed, text_slices, whole

HELD = 1_000_000
FREQUENT, ENDINGS = 224, 288
LEAVES = FREQUENT + ENDINGS
CLASSES, WIDTH = 32, 32
#: Rows of the weight tables, of classes and of leaves; the last rows are biases: one, and one for each class.
FEATURES, LEAF_FEATURES = 1 << 15, 1 << 15
TEMPLATES, LEAF_TEMPLATES = 4, 2
RATES = (0.6,)
BATCH = 4096
BLOCKS = 256
#: Bytes of distinct words in a hash range of the word counts.
RANGE_BYTES = 24 << 20
U = np.uint64
#: The end token: no word holds a line feed.
END = "\n"


def _is_held(i: int | None, modulus: int) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % modulus == 2


def _ending(word: bytes) -> int:
    return 1 + xxhash.xxh32_intdigest(word[-3:]) % (ENDINGS - 1)


def units(docs: DataFrame, modulus: int, id_col: str, text_col: str) -> DataFrame:
    """(unit, ids, held, ends, tokens, hashes, leaves, counts): tokens number the unit's sorted hashes; leaves are those of the words' endings, 0 for the end token; counts are
    those in its training documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("lm", lambda: None)
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        flats: list[pa.DictionaryArray] = []
        counts: list[np.ndarray] = []
        size = 0

        def unit() -> pa.RecordBatch:
            whole_unit = pa.chunked_array(flats).unify_dictionaries()
            raw = [*whole_unit.chunk(0).dictionary.cast(pa.large_binary()).to_pylist(), END.encode()]
            codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole_unit.chunks])
            blank = np.array([w != b"" for w in raw], bool)  # the piece before or behind white space is no word
            some = blank[codes]
            n = np.diff(np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(np.concatenate(counts))])])
            tokens = np.insert(codes[some], np.cumsum(n), len(raw) - 1)
            n = n + 1
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), U, len(raw))
            leaves = np.fromiter(map(_ending, raw), np.uint16, len(raw))
            leaves[-1] = 0
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            flat = place[tokens]
            held = np.array([_is_held(i, modulus) for i in ids])
            seen = np.bincount(flat[np.repeat(~held, n)], minlength=len(order))
            row = {
                "unit": pa.array([part * (1 << 32) + made], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "held": [held.astype(np.uint8).tobytes()],
                "ends": [np.cumsum(n).astype("<i8").tobytes()],
                "tokens": [flat.astype("<u4", copy=False).tobytes()],
                "hashes": [hashes[order].tobytes()],
                "leaves": [leaves[order].tobytes()],
                "counts": [seen.astype("<u4").tobytes()],
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for source, texts in text_slices(batch):
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
                flat = lists.flatten().dictionary_encode()
                # texts near the limit of 32-bit offsets have a type of their own, and a unit has one type
                full = size >= HELD or flats and flats[0].type != flat.type
                if full:
                    yield unit()
                    made, ids, flats, counts, size = made + 1, [], [], [], 0
                flats.append(flat)
                counts.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                ids += source.column(0).to_pylist()
                size += len(flat)
        if ids:
            yield unit()

    schema = "unit long, ids array<long>, held binary, ends binary, tokens binary, hashes binary, leaves binary, counts binary"
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(work, schema)


def _ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return np.minimum((hashes >> U(40)).astype(np.int64) * ranges >> 24, ranges - 1)


def _most(total: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-total, kind="stable")[:n]


def word_counts(made: DataFrame, ranges: int) -> DataFrame:
    """(unit, range, counts, stats, top): the training counts of a unit's words of a hash range; once per range, by ending's leaf the tokens, words and words
    seen once (stats), and the hashes, counts and leaves of its most frequent words (top)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                unit, hashes, leaves, counts = batch.column(0)[k], *(np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, U), (2, np.uint16), (3, "<u4")))
                number = _ranges_of(hashes, ranges)
                found, first = np.unique(number, return_index=True)
                cut_up = list(zip(first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True))
                yield pa.RecordBatch.from_pydict({"range": pa.array(found, pa.int32()), "unit": pa.array([unit.as_py()] * len(found), pa.int64()), **{n: pa.array([x[a:b].tobytes() for a, b in cut_up], pa.binary()) for n, x in (("hashes", hashes), ("leaves", leaves), ("counts", counts))}})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, U) for x in rows["hashes"]]
        words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]])).astype(np.int64)
        leaf = np.zeros(len(words), np.int64)
        leaf[inverse] = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["leaves"]])
        stats = np.stack([np.bincount(leaf, weights=w, minlength=ENDINGS) for w in (total, total > 0, total == 1)]).astype("<i8").tobytes()
        some = _most(np.where(leaf > 0, total, 0), FREQUENT)
        top = np.stack([words[some].view(np.int64), total[some], leaf[some]]).astype("<i8").tobytes()
        back = np.split(total[inverse].astype("<i8"), np.cumsum([len(p) for p in parts])[:-1])
        none = [None] * (len(back) - 1)
        return pd.DataFrame({"unit": rows["unit"], "range": rows["range"], "counts": [b.tobytes() for b in back], "stats": [stats, *none], "top": [top, *none]})

    dealt = made.select("unit", "hashes", "leaves", "counts").mapInArrow(deal, "range int, unit long, hashes binary, leaves binary, counts binary")
    return dealt.groupBy("range").applyInPandas(merge, "unit long, range int, counts binary, stats binary, top binary")


def corpus_statistics(counts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Stats summed over all ranges, and [hash, count, leaf] of the FREQUENT most frequent words, the end token aside."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, top = np.zeros((3, ENDINGS), np.int64), np.zeros((3, 0), np.int64)
        for batch in batches:
            for s, t in zip(batch.column(0), batch.column(1), strict=True):
                stats += np.frombuffer(s.as_buffer(), "<i8").reshape(3, ENDINGS)
                top = np.concatenate([top, np.frombuffer(t.as_buffer(), "<i8").reshape(3, -1)], axis=1)
                top = top[:, np.lexsort((top[0], -top[1]))[:FREQUENT]]
        yield pa.RecordBatch.from_pydict({"stats": [stats.astype("<i8").tobytes()], "top": [top.astype("<i8").tobytes()]})

    one = counts.where("stats IS NOT NULL").select("stats", "top")
    # BLOCKS rows at most, of a fixed size, come to the driver
    found = one.repartition(parts).mapInArrow(add, "stats binary, top binary").collect()
    stats = sum((np.frombuffer(r.stats, "<i8").reshape(3, ENDINGS) for r in found), np.zeros((3, ENDINGS), np.int64))
    top = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(r.top, "<i8").reshape(3, -1) for r in found)], axis=1)
    top = top[:, top[1] > 0]
    return stats, top[:, np.lexsort((top[0], -top[1]))[:FREQUENT]]


class Leaves:
    """Leaf of each word: a place behind the endings for a frequent word, else that of its ending."""

    def __init__(self, stats: np.ndarray, top: np.ndarray) -> None:
        hashes = top[0].view(U)
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], (ENDINGS + order).astype(np.int64)
        # by leaf: tokens, words, words seen once
        self.stats = np.concatenate([stats, np.zeros((3, FREQUENT), np.int64)], axis=1)
        for k, (_, count, leaf) in enumerate(top.T.tolist()):
            own = np.array([count, 1, int(count == 1)])
            self.stats[:, leaf] -= own
            self.stats[:, ENDINGS + k] = own

    def __call__(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = endings.astype(np.int64)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[k] == hashes, self.place[k], out)
        return out


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """held, ends, tokens, hashes, endings of a unit."""
    return tuple(np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((0, np.uint8), (1, "<i8"), (2, "<u4"), (3, U), (4, np.uint16)))


UNIT = ("held", "ends", "tokens", "hashes", "leaves")


def neighbours(made: DataFrame, leaves: Leaves, parts: int) -> np.ndarray:
    """[leaf][next leaf] counts over all training documents."""
    shared = made.sparkSession.sparkContext.broadcast(leaves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(LEAVES * LEAVES, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                held, ends, tokens, hashes, endings = _arrays(batch, k)
                doc = np.repeat(held, np.diff(ends, prepend=0))
                leaf = shared.value(hashes, endings)[tokens]
                pair = (leaf[:-1] * LEAVES + leaf[1:])[(doc[:-1] == 0) & (doc[1:] == 0)]
                out += np.bincount(pair, minlength=LEAVES * LEAVES)
        yield in_blocks(out, parts)

    found = summed(made.select(*UNIT).mapInArrow(work, BLOCK_ROWS), parts)
    return whole(found, LEAVES * LEAVES, parts).reshape(LEAVES, LEAVES)


def clustered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in it of each leaf: k-means over the distributions of what stands before and after, with at most WIDTH leaves a class; the end token is a class of its own."""
    m = np.concatenate([pairs, pairs.T], axis=1).astype(np.float64) + 1e-6
    mass = pairs.sum(axis=1) + pairs.sum(axis=0)
    x = np.sqrt(m / m.sum(axis=1, keepdims=True))
    order = np.argsort(-mass[1:], kind="stable") + 1
    centres = x[order[: CLASSES - 1]]
    label = np.zeros(LEAVES, np.int64)
    for _ in range(15):
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")
        used = np.zeros(len(centres), np.int64)
        for leaf in order.tolist():  # the heaviest choose first
            label[leaf] = next(c for c in near[leaf].tolist() if used[c] < WIDTH)
            used[label[leaf]] += 1
        for c in range(len(centres)):
            if (own := order[label[order] == c]).size:
                mean = np.average(x[own], axis=0, weights=mass[own] + 1e-6)
                centres[c] = mean / np.linalg.norm(mean)
    label[order] += 1
    label[0] = 0
    slot = np.zeros(LEAVES, np.int64)
    for c in range(CLASSES):
        own = np.flatnonzero(label == c)
        slot[own] = np.arange(len(own))
    return label, slot


class Model:
    """The tree of classes and leaves with its weights."""

    def __init__(self, leaves: Leaves, label: np.ndarray, slot: np.ndarray) -> None:
        self.leaves, self.label, self.slot = leaves, label, slot
        tokens = leaves.stats[0] + 0.5
        of_class = np.bincount(label, weights=tokens, minlength=CLASSES)
        self.classes = np.zeros((FEATURES, CLASSES), np.float32)
        self.classes[-1] = np.log(np.maximum(of_class, 1e-3) / of_class.sum())
        self.slots = np.zeros((LEAF_FEATURES, WIDTH), np.float32)
        bias = np.full((CLASSES, WIDTH), -np.inf, np.float32)
        bias[label, slot] = np.log(tokens / of_class[label])
        bias[~np.isfinite(bias).any(axis=1)] = 0
        self.none = ~np.isfinite(bias)  # places that hold no leaf
        self.slots[-CLASSES:] = np.where(self.none, 0, bias)


def _places(ends: np.ndarray) -> np.ndarray:
    """Of each token its place in its document."""
    sizes = np.diff(ends, prepend=0)
    return (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)).astype(np.int32)


def _features(hashes: np.ndarray, tokens: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[template][token] hashes of the history of the tokens ``at``; it does not reach beyond their document."""
    before = []
    for j in (1, 2, 3):
        w = hashes[tokens[np.maximum(at - j, 0)]]
        w[place[at] < j] = U(j)
        before.append(w)
    mixed = (before[0], before[0] * U(0x9E3779B97F4A7C15) + before[1], before[1], before[2])
    out = np.empty((TEMPLATES, len(at)), U)
    for t, h in enumerate(mixed):
        out[t] = (h ^ (h >> U(29)) ^ U(t + 1)) * U(0xBF58476D1CE4E5B9)
    return out


def _class_rows(f: np.ndarray) -> np.ndarray:
    return ((f >> U(40)) % U(FEATURES - 1)).astype(np.int32)


def _leaf_rows(f: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows of the leaves' table: the history's first features, each with the class, and the class's bias."""
    mixed = (f[:LEAF_TEMPLATES] ^ (label.astype(U) + U(1)) * U(0x94D049BB133111EB)) * U(0x9E3779B97F4A7C15)
    return np.concatenate([((mixed >> U(40)) % U(LEAF_FEATURES - CLASSES)).astype(np.int32), (LEAF_FEATURES - CLASSES + label).astype(np.int32)[None]])


def _softmax(w: np.ndarray, rows: np.ndarray, bias: bool, none: np.ndarray | None = None) -> np.ndarray:
    z = w.take(rows[0], axis=0)
    for row in rows[1:]:
        z += w.take(row, axis=0)
    if bias:
        z += w[-1]  # every history has it
    if none is not None:
        z[none] = -np.inf
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _sums(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of the gradients of each; rows that stand there once, most of them, are taken as they are."""
    order = np.argsort(row.astype(np.uint16) if FEATURES <= 1 << 16 and LEAF_FEATURES <= 1 << 16 else row, kind="stable")
    ordered, g = row[order], g.take(order, axis=0)
    first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    sizes = np.diff(np.append(first, len(ordered)))
    total = g.take(first, axis=0)
    if len(several := np.flatnonzero(sizes > 1)):
        total[several] = np.add.reduceat(g[np.repeat(sizes > 1, sizes)], np.cumsum(sizes[several]) - sizes[several], axis=0)
    return ordered[first].astype(np.int64), total


def _step(w: np.ndarray, square: np.ndarray, rate: float, g: np.ndarray, rows: np.ndarray, bias: bool) -> None:
    """An Adagrad step of the rows that the batch touches, with one rate for each row."""
    for row in rows:
        at, total = _sums(g, row)
        square[at] += np.einsum("ij,ij->i", total, total)
        total *= (np.float32(rate) / np.sqrt(square[at]))[:, None]
        w[at] -= total
    if bias:
        total = g.sum(axis=0)
        square[-1] += float(total @ total)
        w[-1] -= np.float32(rate / np.sqrt(square[-1])) * total


def trained(made: DataFrame, model: Model, number: int) -> Model:
    """The weights after local Adagrad steps, averaged over tasks by the tokens that each has seen; a task sends what it has changed."""
    context = made.sparkSession.sparkContext
    for rate in RATES:
        shared = context.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], rate: float = rate, shared=shared) -> Iterator[pa.RecordBatch]:
            own_worker("lm", lambda: None)
            m = shared.value
            classes, slots = m.classes.copy(), m.slots.copy()
            squares = np.full(len(classes), 1e-3, np.float32), np.full(len(slots), 1e-3, np.float32)
            seen = 0
            for batch in batches:
                for k in range(batch.num_rows):
                    held, ends, tokens, hashes, endings = _arrays(batch, k)
                    leaf = m.leaves(hashes, endings)
                    label, slot = m.label[leaf], m.slot[leaf]
                    place = _places(ends)
                    learn = np.flatnonzero(np.repeat(held, np.diff(ends, prepend=0)) == 0)
                    seen += len(learn)
                    for a in range(0, len(learn), BATCH):
                        at = learn[a : a + BATCH]
                        some, y = _features(hashes, tokens, place, at), label[tokens[at]]
                        rows = _class_rows(some)
                        g = _softmax(classes, rows, True)
                        g[np.arange(len(at)), y] -= 1
                        _step(classes, squares[0], rate, g, rows, True)
                        # the end token is alone in its class
                        inner = np.flatnonzero(y > 0)
                        if len(inner):
                            rows = _leaf_rows(some[:, inner], y[inner])
                            g = _softmax(slots, rows, False, m.none[y[inner]])
                            g[np.arange(len(inner)), slot[tokens[at[inner]]]] -= 1
                            _step(slots, squares[1], rate, g, rows, False)
            parts = [np.array_split(((x - y) * np.float32(seen)).reshape(-1), number) for x, y in ((classes, m.classes), (slots, m.slots))]
            yield pa.RecordBatch.from_pydict({"number": pa.array(range(number), pa.int32()), "seen": pa.array([seen] * number, pa.int64()), "classes": [x.astype("<f4").tobytes() for x in parts[0]], "slots": [x.astype("<f4").tobytes() for x in parts[1]]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The sums of each block, as its parts stream by."""
            held: dict[int, list] = {}
            for batch in batches:
                for number, seen, *data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    own = held.setdefault(number, [0, None, None])
                    own[0] += seen
                    for j, x in enumerate(data, 1):
                        x = np.frombuffer(x.as_buffer(), "<f4")
                        own[j] = x.astype(np.float64) if own[j] is None else own[j] + x
            for number, (seen, a, b) in held.items():
                yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "seen": pa.array([seen], pa.int64()), "classes": [(a / max(seen, 1)).astype("<f4").tobytes()], "slots": [(b / max(seen, 1)).astype("<f4").tobytes()]})

        schema = "number int, seen long, classes binary, slots binary"
        # ``number`` rows, the weights together: a fixed size
        found = made.select(*UNIT).mapInArrow(work, schema).repartition(number, "number").mapInArrow(add, schema).collect()
        found = sorted(found, key=lambda r: r.number)
        if len(found) == number and found[0].seen:
            model.classes = model.classes + np.concatenate([np.frombuffer(r.classes, "<f4") for r in found]).reshape(model.classes.shape)
            model.slots = model.slots + np.concatenate([np.frombuffer(r.slots, "<f4") for r in found]).reshape(model.slots.shape)
    return model


def word_factors(model: Model, leaf: np.ndarray, own: np.ndarray) -> np.ndarray:
    """P(word | leaf) of words with their counts: what a leaf has seen once tells how much of it is new; 1 for a leaf of one frequent word."""
    tokens, words, once = model.leaves.stats
    new = np.clip(np.where(words > 1, (once + 0.5) / (tokens + 1.0), 0.5 / (tokens + 1.0)), 1e-9, 0.5)
    shared = np.where(own > 0, (1 - new[leaf]) * own / np.maximum(tokens[leaf], 1), new[leaf])
    return np.where((leaf >= ENDINGS) | (leaf == 0) & (tokens[0] > 0), 1.0, shared)


def scored(docs: DataFrame, modulus: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from documents whose crc32(id as text) mod ``modulus`` is not 2, a null id among them. A null or empty text is the end token
    alone. Repeated rows count and come back as often as they stand there; other columns are ignored; an empty table gives an empty result.
    """
    made = cut(units(docs, modulus, id_col, text_col), "units")
    volume, numbered = made.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(8, min(BLOCKS, numbered))
    counts = cut(word_counts(made, max(8, -(-volume // RANGE_BYTES))), "counts")
    stats, top = corpus_statistics(counts, parts)
    n, v = int(stats[0].sum()), int(stats[1].sum())
    leaves = Leaves(stats, top)
    model = trained(made, Model(leaves, *clustered(neighbours(made, leaves, parts))), parts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("lm", lambda: None)
        m = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                held, ends, tokens, hashes, endings = _arrays(batch, k)
                own = np.concatenate([np.frombuffer(x["counts"], "<i8") for x in batch.column(6)[k].as_py()])
                leaf = m.leaves(hashes, endings)
                label, slot = m.label[leaf], m.slot[leaf]
                word, base, known = np.log10(word_factors(m, leaf, own)), np.log10((own + 1) / (n + 1 * (v + 1))), own > 0
                place, p = _places(ends), np.empty(len(tokens))
                for a in range(0, len(tokens), BATCH):
                    some, at = _features(hashes, tokens, place, np.arange(a, min(a + BATCH, len(tokens)))), tokens[a : a + BATCH]
                    y, line = label[at], np.arange(len(at))
                    q = _softmax(m.classes, _class_rows(some), True)[line, y].astype(np.float64)
                    inner = np.flatnonzero(y > 0)
                    if len(inner):
                        r = _softmax(m.slots, _leaf_rows(some[:, inner], y[inner]), False, m.none[y[inner]])
                        q[inner] *= r[np.arange(len(inner)), slot[at[inner]]]
                    p[a : a + BATCH] = q
                value = np.log10(np.maximum(p, 1e-30)) + word[tokens]
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every document has its end token
                yield pa.RecordBatch.from_arrays(
                    [batch.column(5)[k].values, pa.array(held == 1), pa.array(np.diff(ends, prepend=0)), pa.array(add(known[tokens].astype(np.int64))), pa.array(np.full(len(ends), n, np.int64)), pa.array(add(base[tokens])), pa.array(add(value))],
                    names=names,
                )

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sums = counts.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("range", "counts"))).alias("sums")).withColumnRenamed("unit", "of")
    both = made.join(sums, F.col("unit") == F.col("of")).select(*UNIT, "ids", "sums")
    return both.mapInArrow(work, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
