"""Language identification by interpolated Kneser-Ney character models, one per language.

Each model is fitted on the whole texts of up to ``SAMPLE_DOCS`` labelled documents of its language (those of the smallest hash of
the id; ids are chosen first, texts fetched after), inside one task per language. Models are sorted arrays of n-gram hashes; those of all languages are merged, so that one
binary search serves them all. A word is scored between word borders, once per distinct word and worker; a document gets the
language of the lowest cross-entropy per character. A fifth of the sample is kept out of the counts to calibrate rejection: a
document is rejected where its cross-entropy is above the mean of those texts by more than ``Z`` standard errors for its length and the ``QUANTILE`` of
what they themselves exceed that by.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import mapped, own_worker, text_slices

#: Documents per language that a model is fitted on, at most.
SAMPLE_DOCS = 200
ORDER = 5
#: Parts that a worker keeps scored; when full, its cache starts anew. Words that are scored at once.
CACHE, AT_ONCE = 200_000, 16_384
#: Characters that an unseen one is one of.
ALPHABET = 5000
#: Rejection: standard errors for a text's length, the quantile of the calibration texts' own excess, and the nats per character that are allowed for what a sample cannot show.
Z, QUANTILE, MARGIN = 6.0, 0.99, 1.5
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word number and place of each predicted character (a word's letters and its end), and the hashes of the n-grams that end there, by n."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    start = codes == 2
    word = np.cumsum(start) - 1
    place = np.arange(len(codes)) - np.flatnonzero(start)[word] if len(codes) else np.zeros(0, np.int64)
    hashes = [_mixed(codes * MIX)]
    for n in range(2, ORDER + 1):
        h = np.zeros_like(codes)
        h[n - 1 :] = _mixed(hashes[-1][n - 1 :] * np.uint64(0x94D049BB133111EB) + codes[: len(codes) - n + 1] * MIX + np.uint64(n))
        hashes.append(h)
    return word, place, hashes


def fit(counts: Counter) -> dict:
    """The model of a language from its counted words: by order the sorted n-gram hashes with probabilities, and the sorted context hashes with back-off weights."""
    words = list(counts)
    weight = np.array([counts[w] for w in words], np.float64)
    word, place, hashes = _grams(words)
    model: dict = {"p": [], "gamma": []}
    base = 1.0 / ALPHABET
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        at = np.flatnonzero((place >= 1) & (place >= n - 1))
        keys, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        if n == ORDER:
            adjusted = np.bincount(inverse, weights=weight[word[at]], minlength=len(keys))
        else:  # distinct characters before the n-gram; where it opens a word, its count
            inside = place[at] >= n
            pairs = np.unique(np.stack([hashes[n][at[inside]], inverse[inside].astype(np.uint64)]), axis=1)[1].astype(np.int64)
            adjusted = np.bincount(pairs, minlength=len(keys)) + np.bincount(inverse[~inside], weights=weight[word[at[~inside]]], minlength=len(keys))
        once, twice = (adjusted == 1).sum(), (adjusted == 2).sum()
        discount = float(np.clip(once / (once + 2 * twice) if once + twice else 0.5, 0.1, 0.95))
        context = hashes[n - 2][at[first] - 1] if n > 1 else np.zeros(len(keys), np.uint64)
        contexts, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, weights=adjusted)
        gamma = discount * np.bincount(group) / total
        below = base if lower is None else lower[1][np.searchsorted(lower[0], hashes[n - 2][at[first]])]
        p = np.maximum(adjusted - discount, 0) / total[group] + gamma[group] * below
        model["p"].append((keys, p))
        model["gamma"].append((contexts, gamma))
        lower = (keys, p)
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


class Merged:
    """The models of all languages over common sorted hash arrays."""

    def __init__(self, langs: list[str], models: list[dict]) -> None:
        self.langs = langs
        self.p = [self._merge([m["p"][n] for m in models], np.nan) for n in range(ORDER)] if models else []
        self.gamma = [self._merge([m["gamma"][n] for m in models], 1.0) for n in range(ORDER)] if models else []
        self.clear()

    @staticmethod
    def _merge(tables: list, missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.full((len(keys), len(tables)), missing, np.float32)
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "values")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.zeros((0, len(self.langs) + 1))

    def scores(self, words: list[str]) -> np.ndarray:
        """For each word the log-probability by language, and last the number of predicted characters."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        word, place, hashes = _grams(words)
        at = np.flatnonzero(place >= 1)
        out[:, -1] = np.bincount(word[at], minlength=len(words))
        if not self.langs:
            return out
        p = np.full((len(at), len(self.langs)), 1.0 / ALPHABET, np.float32)
        for n in range(1, ORDER + 1):
            here = np.flatnonzero(place[at] >= n - 1)
            context = hashes[n - 2][at[here] - 1] if n > 1 else np.zeros(len(here), np.uint64)
            c, has = _find(self.gamma[n - 1][0], context)
            here, c = here[has], c[has]  # a context that no language has seen changes nothing
            q = p[here] * self.gamma[n - 1][1][c]
            g, seen = _find(self.p[n - 1][0], hashes[n - 1][at[here]])
            known = self.p[n - 1][1][g[seen]]
            q[seen] = np.where(np.isnan(known), q[seen], known)
            p[here] = q
        logs = np.log(np.maximum(p, 1e-30))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(word[at], weights=logs[:, j], minlength=len(words))
        return out

    def lookup(self, parts: list[str]) -> np.ndarray:
        """As scores(), of white-space separated parts; each distinct one is scored once."""
        if len(self.index) > CACHE:
            self.clear()
        found = list(map(self.index.get, parts))
        if None in found:
            new = [p for p, i in zip(parts, found, strict=True) if i is None]
            runs = [[p.lower()] if p.isalpha() else LETTERS.findall(p.lower()) for p in new]
            place: dict[str, int] = {}
            flat = np.fromiter((place.setdefault(w, len(place)) for r in runs for w in r), np.int64)
            words = list(place)
            scores = np.concatenate([np.zeros((0, len(self.langs) + 1)), *(self.scores(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE))])
            ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
            sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[flat], axis=0)])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.values = np.concatenate([self.values, sums[ends] - sums[np.concatenate([[0], ends[:-1]])]])
            found = list(map(self.index.__getitem__, parts))
        return self.values[np.array(found, np.int64)]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by language, and the number of characters, of each text."""
        parts = pc.utf8_split_whitespace(texts)
        distinct = parts.flatten().dictionary_encode()
        values, codes = self.lookup(distinct.dictionary.to_pylist()), distinct.indices.to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(sizes)
        sums = np.zeros((len(texts), len(self.langs) + 1))
        if len(some):
            begins = (np.cumsum(sizes) - sizes)[some]
            for j in range(sums.shape[1]):
                sums[some, j] = np.add.reduceat(np.ascontiguousarray(values[:, j])[codes], begins)
        n = np.round(sums[:, -1])
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n


class Identifier:
    def __init__(self, models: list[tuple[str, dict, list[str]]]) -> None:
        models = sorted(models, key=lambda x: x[0])
        self.merged = Merged([x[0] for x in models], [x[1] for x in models])
        self.mean, self.spread, self.margin = np.zeros(len(models)), np.ones(len(models)), np.full(len(models), MARGIN)
        for j, (_, _, kept_out) in enumerate(models):
            ce, n = self.merged.documents(pa.array(kept_out, pa.string()))
            ce, n = ce[n > 0, j], n[n > 0]
            if len(ce):
                self.mean[j] = np.average(ce, weights=n)
                self.spread[j] = max(0.5, float(np.sqrt(np.average((ce - self.mean[j]) ** 2 * n))))
                self.margin[j] = MARGIN + max(0.0, float(np.quantile(ce - self.mean[j] - Z * self.spread[j] / np.sqrt(n), QUANTILE)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and whether it is rejected, of each text; no text is null."""
        ce, n = self.merged.documents(texts)
        if not self.merged.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = ce.argmin(axis=1)
        lowest = ce[np.arange(len(texts)), best]
        score = 1 / np.exp(np.clip((lowest[:, None] - ce) * np.sqrt(np.maximum(n, 1))[:, None], -50, 0)).sum(axis=1)
        none = n == 0
        rejected = none | (lowest > self.mean[best] + Z * self.spread[best] / np.sqrt(np.maximum(n, 1)) + self.margin[best])
        score[none] = 0.0
        return [UNKNOWN if x else self.merged.langs[k] for x, k in zip(none, best, strict=True)], score, rejected


def held_out(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text leaves 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def train(docs: DataFrame, modulus: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Fits on documents with an id, a text and a language that are not held out. Models, bounded by SAMPLE_DOCS per language, come to the driver."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"), modulus))
    # the rows' hashes are ranked without their texts; each task sends SAMPLE_DOCS of a language at most
    ranked = labelled.select("lang", F.xxhash64(F.col("id").cast("string")).alias("h"), F.col("id").cast("string").alias("i"), F.xxhash64("text").alias("t"))
    order = Window.partitionBy("lang").orderBy("h", "i", "t")
    chosen = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    # SAMPLE_DOCS rows a language, of a few numbers each; only their own rows' texts are shuffled
    picked = F.broadcast(chosen.groupBy("lang", "h", "i", "t").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies")).select(F.col("lang").alias("pl"), F.col("h").alias("ph"), F.col("i").alias("pi"), F.col("t").alias("pt"), "k"))
    keyed = labelled.withColumn("h", F.xxhash64(F.col("id").cast("string"))).withColumn("t", F.xxhash64("text"))
    sample = keyed.join(picked, (F.col("h") == F.col("ph")) & (F.col("lang") == F.col("pl")) & (F.col("id").cast("string") == F.col("pi")) & (F.col("t") == F.col("pt"))).dropDuplicates(["lang", "h", "pi", "t"]).select("lang", "text", "k")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("k")["text"].tolist()
        kept_out = texts[4::5]
        counts: Counter = Counter()
        for k, t in enumerate(texts):
            if k % 5 != 4:
                counts.update(LETTERS.findall(t.lower()))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "model": [pickle.dumps((fit(counts), kept_out)) if counts else None]})

    models = sample.groupBy("lang").applyInPandas(learn, "lang string, model binary").where("model IS NOT NULL").collect()
    return Identifier([(r.lang, *pickle.loads(r.model)) for r in models])


def identified(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, rejected. A null text, or one without a letter, is ``und``, score 0, rejected.

    Nothing but the text is read. Repeated rows and null ids come back as they are; other columns are ignored; an empty table gives
    an empty result, and a model that has learned no language calls every text ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("langid", shared.value.merged.clear)
        for batch in batches:
            for source, texts in text_slices(batch):
                langs, score, rejected = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([source.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns, whatever their names.

    Null texts, empty ones and those without a letter go; repeated rows stay or go alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("langid", shared.value.merged.clear)
        for batch in batches:
            for source, texts in text_slices(batch, at):
                yield source.filter(pa.array(~shared.value.predict(texts)[2]))

    return mapped(docs, work)
