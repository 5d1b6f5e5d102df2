"""Byte-level BPE encoding and decoding by speculation and verification.

Texts are cut, column-wise, into chunks that no pre-token crosses, and each distinct chunk is encoded once per worker. For words not seen
before, greedy longest match, a step of all words at a time over a trie, proposes tokens; a vectorised check then tests every adjacent pair of proposed tokens for compatibility,
that is whether some merge would have joined material across their border before both tokens were complete. A sequence whose
tokens are stable and whose adjacent pairs are all compatible is the BPE encoding; only words that fail are merged exactly, short ones side by side.

Decoding gathers the bytes of the ids and reads them as UTF-8, invalid sequences becoming U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from inkwell.llm.common import own_worker, text_slices

# The pre-tokenizer's pattern and Unicode's White_Space.
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Entries of a worker's cache of encoded chunks; when full it starts anew, so it bounds memory and changes no result.
CACHE = 300_000
#: Stands before a chunk while texts are parted; bytes of the longest word that is merged side by side with others.
SEPARATOR, LONG = "\0", 32
NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for each i, joined."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(total)]


def joined(sizes: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The ids of all words in their order, from parts (numbers of words, their ids joined) that together hold each word once."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for of, ids in parts:
        n = sizes[of]
        out[np.repeat(ends[of] - np.cumsum(n), n) + np.arange(len(ids))] = ids
    return out


class ByteBpe:
    """A byte-level BPE vocabulary: encode words (bytes) to ids exactly, decode ids to bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        self.byte_id = {self.tokens[i][0]: i for i in vocab.values() if len(self.tokens[i]) == 1}
        self.size = size
        ids = {t: i for i, t in enumerate(self.tokens) if t}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[a], vocab[b]
            new = ids[self.tokens[a] + self.tokens[b]]
            self.merge[a, b] = (r, new)
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = r, a, b
        pairs = np.array([(a * size + b, r) for (a, b), (r, _) in self.merge.items()], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        self.keys, self.key_rank = pairs[order, 0], pairs[order, 1]
        self.key_new = np.array([new for _, new in self.merge.values()], np.int32)[order]
        self.id_of_byte = np.array([self.byte_id.get(b, -1) for b in range(256)], np.int32)
        self.right_spine, self.left_spine = self._spines(self.right), self._spines(self.left)
        whole = np.flatnonzero(self.left >= 0)
        stable = np.ones(size, bool)
        ok = self._compatible(self.left[whole], self.right[whole], own_merge=True)
        for t, fits in zip(whole[np.argsort(self.rank[whole])], ok[np.argsort(self.rank[whole])], strict=True):
            stable[t] = fits and stable[self.left[t]] and stable[self.right[t]]
        self.stable_ids = {t: i for t, i in ids.items() if stable[i]}
        self._trie()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _spines(self, child: np.ndarray) -> list[np.ndarray]:
        """[depth][token]: the token, then its outermost child again and again; -1 beyond the last."""
        at, out = np.arange(self.size), []
        while (at >= 0).any():
            out.append(at)
            at = np.where(at >= 0, child[np.maximum(at, 0)], -1)
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray, own_merge: bool = False) -> np.ndarray:
        """Whether no merge joins material across the border of a and b before both are complete. own_merge: that of a with b itself is allowed."""
        fits = np.ones(len(a), bool)
        for i, right in enumerate(self.right_spine):
            x = right[a]
            if not (x >= 0).any():
                break
            until_x = self.rank[self.right_spine[i - 1][a]] if i else np.full(len(a), NEVER)
            for j, left in enumerate(self.left_spine):
                if own_merge and i == j == 0:
                    continue
                at = np.flatnonzero((x >= 0) & (left[b] >= 0) & fits)
                if not len(at):
                    if not (left[b] >= 0).any():
                        break
                    continue
                y = left[b[at]]
                key = x[at] * self.size + y
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[k] == key, self.key_rank[k], NEVER)
                until_y = self.rank[self.left_spine[j - 1][b[at]]] if j else np.full(len(at), NEVER)
                # of equal merges the leftmost goes first: the border's merge waits for one on its left, not for one on its right
                fits[at[(rank < NEVER) & (rank < until_x[at]) & (rank <= until_y)]] = False
        return fits

    def _trie(self) -> None:
        """A trie over the stable tokens: nodes 1 + byte stand for single bytes; other edges are sorted keys node * 256 + byte."""
        self.token_at = [-1] + [self.byte_id.get(b, -1) for b in range(256)]
        edges: dict[int, int] = {}
        for t, i in self.stable_ids.items():
            node = 1 + t[0]
            for b in t[1:]:
                node = edges.setdefault(node * 256 + b, len(edges) + 257)
            if node >= len(self.token_at):
                self.token_at += [-1] * (node + 1 - len(self.token_at))
            self.token_at[node] = i
        self.token_at = np.array(self.token_at + [-1] * (len(edges) + 257 - len(self.token_at)), np.int32)
        keys, nodes = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], nodes[order]
        self.edge_of_byte = np.zeros((256, 256), np.int32)
        shallow = self.edge_keys < 257 * 256
        self.edge_of_byte[self.edge_keys[shallow] // 256 - 1, self.edge_keys[shallow] % 256] = self.edge_nodes[shallow]

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node along a byte; 0 where there is none."""
        out = np.zeros(len(node), np.int32)
        root, shallow = node == 0, (node > 0) & (node < 257)
        out[root] = 1 + byte[root].astype(np.int32)
        out[shallow] = self.edge_of_byte[node[shallow] - 1, byte[shallow]]
        if len(deep := np.flatnonzero(node >= 257)):
            key = node[deep].astype(np.int64) * 256 + byte[deep]
            k = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            out[deep] = np.where(self.edge_keys[k] == key, self.edge_nodes[k], 0)
        return out

    def _greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once, a byte of each at a time: (place in data, token), in order of place."""
        begin, at, end = starts.copy(), starts.copy(), ends
        node, best, best_end = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), starts.copy()
        places, tokens = [], []
        while len(at):
            more = at < end
            child = np.zeros(len(at), np.int32)
            child[more] = self._next(node[more], data[at[more]])
            goes = child > 0
            at = at + goes
            node = child
            token = self.token_at[child]
            hit = goes & (token >= 0)
            best[hit], best_end[hit] = token[hit], at[hit]
            if len(stop := np.flatnonzero(~goes)):
                places.append(begin[stop])
                tokens.append(best[stop])
                begin[stop] = at[stop] = best_end[stop]
                open_ = goes | (begin < end)
                if not open_.all():
                    begin, at, end, node, best, best_end = (x[open_] for x in (begin, at, end, node, best, best_end))
        place, token = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int32), *tokens])
        order = np.argsort(place, kind="stable")
        return place[order], token[order]

    def _exact(self, word: bytes) -> list[int]:
        """The merges themselves, lowest rank first and leftmost of equals; a heap keeps long words near-linear."""
        n = len(word)
        ids: list[int] = [self.byte_id[b] for b in word]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.merge[p][0], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (m := self.merge.get((ids[i], ids[j]))) is None or m[0] != rank:
                continue
            ids[i], ids[j] = m[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m[0], x))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the merge of each pair, NEVER where there is none, and its place among the merges."""
        key = a.astype(np.int64) * self.size + b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (a >= 0) & (b >= 0), self.key_rank[k], NEVER), k

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        """The merges themselves for many short words side by side, each a row of ids ended by -1: in every step each row does its first merge of lowest rank."""
        out, number = np.full(rows.shape, -1, np.int32), np.arange(len(rows))
        rank = self._ranks(rows[:, :-1].ravel(), rows[:, 1:].ravel())[0].reshape(len(rows), -1)
        columns = np.arange(rows.shape[1])
        while len(rows):
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            live = rank[line, at] < NEVER
            if not live.all():
                out[number[~live]] = rows[~live]
                rows, rank, number, at = rows[live], rank[live], number[live], at[live]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            new = self.key_new[self._ranks(rows[line, at], rows[line, at + 1])[1]]
            source = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            rows = np.take_along_axis(rows, source, axis=1)
            rows[:, -1] = -1
            rows[line, at] = new
            rank = np.take_along_axis(rank, source[:, :-1].clip(max=rank.shape[1] - 1), axis=1)
            rank[:, -1] = NEVER
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self._ranks(rows[has, at[has] - 1], rows[has, at[has]])[0]
            has = np.flatnonzero(at + 1 < len(columns))
            rank[has, at[has]] = self._ranks(rows[has, at[has]], rows[has, at[has] + 1])[0]
        return out

    def _exactly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the merges themselves."""
        lengths = np.array([len(w) for w in words], np.int64)
        sizes, parts = np.zeros(len(words), np.int64), []
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, LONG)):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(of):
                data = np.frombuffer(b"".join(words[k].ljust(high, b"\0") for k in of.tolist()), np.uint8).reshape(-1, high)
                found = self._merged(np.where(np.arange(high) < lengths[of][:, None], self.id_of_byte[data], -1).astype(np.int32))
                sizes[of] = (found >= 0).sum(axis=1)
                parts.append((of, found[found >= 0]))
        for k in np.flatnonzero(lengths > LONG).tolist():
            ids = np.array(self._exact(words[k]), np.int32)
            sizes[k] = len(ids)
            parts.append((np.array([k]), ids))
        return joined(sizes, parts), sizes

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the tokens of all words joined, and how many each has. No word is empty."""
        get = self.stable_ids.get
        whole = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        sizes, parts = np.ones(len(words), np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        several = np.flatnonzero(whole < 0)
        if len(several):
            some = [words[k] for k in several.tolist()]
            ends = np.cumsum([len(w) for w in some])
            starts = np.concatenate([[0], ends[:-1]])
            place, token = self._greedy(np.frombuffer(b"".join(some), np.uint8), starts, ends)
            word = np.searchsorted(ends, place, side="right")
            first = np.flatnonzero(word[1:] == word[:-1])
            pair, inverse = np.unique(token[first].astype(np.int64) * self.size + token[first + 1], return_inverse=True)
            failed = np.zeros(len(some), bool)
            failed[word[first[~self._compatible(pair // self.size, pair % self.size)[inverse]]]] = True
            sizes[several] = np.bincount(word, minlength=len(some))
            parts.append((several[~failed], token[~failed[word]]))
            if failed.any():
                wrong = np.flatnonzero(failed).tolist()
                ids, n = self._exactly([some[k] for k in wrong])
                sizes[several[wrong]] = n
                parts.append((several[wrong], ids))
        return joined(sizes, parts), sizes

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


class Chunks:
    """Ids of chunks, each distinct one encoded once: ``lookup`` gives a position in ``starts`` and ``sizes`` for every chunk, and ``flat`` has the ids."""

    def __init__(self, encode, limit: int | None = None) -> None:
        self.encode, self.limit = encode, limit or CACHE
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, parts: list) -> np.ndarray:
        if len(self.index) > self.limit:
            self.clear()
        found = list(map(self.index.get, parts))
        if None in found:
            new = list(dict.fromkeys(p for p, i in zip(parts, found, strict=True) if i is None))
            flat, sizes = self.encode(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32, copy=False)])
            found = list(map(self.index.__getitem__, parts))
        return np.array(found, np.int64)

    def of(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the parts."""
        at = self.lookup(parts)
        return gather(self.flat, self.starts[at], self.sizes[at]), self.sizes[at]

    def ids(self, documents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the documents, each a list of chunks, joined, and where each one ends."""
        distinct = documents.flatten().dictionary_encode()
        at = self.lookup(distinct.dictionary.to_pylist())[distinct.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.flat, self.starts[at], sizes), totals[np.cumsum(pc.list_value_length(documents).to_numpy(zero_copy_only=False))]


def chunked(texts: pa.Array, special: list[str]) -> pa.Array:
    """Lists of chunks that no pre-token crosses; a special token is a chunk of its own.

    A chunk begins at a blank or line feed, or at the last of several white-space characters. Texts that hold the separator used
    for this, a special token or white space in a row at their end are parted by the pre-tokenizer's own pattern.
    """
    odd = pc.or_(pc.match_substring(texts, SEPARATOR), pc.match_substring_regex(texts, rf"[{WS}]{{2,}}\z"))
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    runs = pc.match_substring_regex(texts, f"[{WS}]{{2}}")
    plain = pc.replace_substring(pc.replace_substring(texts, " ", SEPARATOR + " "), "\n", SEPARATOR + "\n")
    if pc.any(runs).as_py():
        plain = pc.if_else(runs, pc.replace_substring_regex(texts, f"([{WS}]*)([{WS}])", rf"{SEPARATOR}\1{SEPARATOR}\2"), plain)
    out = pc.split_pattern(plain, SEPARATOR)
    if not pc.any(odd).as_py():
        return out
    splits = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    own = [[p for x in (splits.split(t) if splits else [t]) for p in ([x] if x in special else PATTERN.findall(x))] if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
    return pc.if_else(odd, pa.array(own, out.type), out)


def _resolver(bpe: ByteBpe):
    words = Chunks(lambda new: bpe.encode_words([w.encode() for w in new]))

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): chunks are parted into pre-tokens, of which each distinct one is encoded once."""
        counts, flat, special = np.ones(len(parts), np.int64), [], []
        for k, p in enumerate(parts):
            if p.isalpha() or p[:1] == " " and p[1:].isalpha():
                flat.append(p)
            elif p in bpe.special:
                special.append((k, p))
                counts[k] = 0
            else:
                found = PATTERN.findall(p)
                counts[k] = len(found)
                flat += found
        ids, n = words.of(flat)
        ends, totals = np.cumsum(counts), np.concatenate([[0], np.cumsum(n)])
        sizes = totals[ends] - totals[ends - counts]
        if not special:
            return ids, sizes
        places = [k for k, _ in special]
        sizes[places] = 1
        others = np.ones(len(parts), bool)
        others[places] = False
        return joined(sizes, [(np.flatnonzero(others), ids), (np.array(places), np.array([bpe.special[p] for _, p in special], np.int32))]), sizes

    def clear() -> None:
        words.clear()

    return encode, clear


class Encoder:
    """A vocabulary with its caches, which live as long as the worker runs tasks of this operator."""

    def __init__(self, path: str) -> None:
        self.bpe = ByteBpe(path)
        encode, self._clear_words = _resolver(self.bpe)
        self.chunks = Chunks(encode)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.ids(chunked(texts, list(self.bpe.special)))

    def clear(self) -> None:
        self.chunks.clear()
        self._clear_words()


@lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), decoded text.

    A null or empty text gives no ids. Repeated rows and null ids come back as they are; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    return _run(docs, path, id_col, text_col, False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encoded(), with n_tokens, ids_sha256 and decoded_sha256 instead of ids and text, so that little leaves the workers."""
    return _run(docs, path, id_col, text_col, True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        bpe = encoder.bpe
        own_worker("bpe", encoder.clear)
        for batch in batches:
            for source, texts in text_slices(batch):
                ids, ends = encoder.encode(texts)
                raw = bpe.decode(ids)
                raw_ends = np.concatenate([[0], np.cumsum(bpe.sizes[ids])])[ends]
                low, rows = ids.astype("<u4"), []
                a = x = 0
                for b, y in zip(ends.tolist(), raw_ends.tolist(), strict=True):
                    text = raw[x:y].decode("utf-8", "replace")
                    if digest:
                        rows.append((b - a, hashlib.sha256(low[a:b].tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        rows.append((low[a:b].tolist(), text))
                    a, x = b, y
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([source.column(0), *columns], names=names)

    kind = dict(docs.dtypes)[id_col]
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
    names = [id_col, *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, {rest}")
