"""Licence scans over a positional index of rare words.

The index maps each word of the licence templates to its postings (template, position) and its IDF over the templates. Files are parted into words column-wise.
Of each file all words of a high IDF (``RARE``: those in at most a quarter of the templates), the file's rare licence words, are looked up wherever they stand:
a posting and the word's place in the file give the place at which the template would begin, and postings intersect where they agree on one, give or take small
edits. So every region of a file has votes of its own, and neither prose nor other licences in it take any away. A template is found where at least half of its
rare words, and at least ``LEAST``, agree, and its mandatory key phrases stand in the file near that place. Every file goes this way; nothing decides before the index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Base: the places where the words of a base phrase stand consecutively.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkwell.llm.common import text_slices

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Passages of well-known public licences, and the phrases that each must show.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted",),
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("under the license", "you may not use this file"),
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty",
        ("free software", "general public license"),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    "cc-by-notice": ("this work is licensed under a creative commons attribution international license to view a copy of this license visit", ("creative commons attribution",)),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software", "public domain")),
}
# Further notices of well-known public licences, and the phrases that each must show.
TEMPLATES |= {
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty",
        ("this library is free software", "lesser general public license"),
    ),
    "agpl-notice": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("affero general public license",),
    ),
    "bsd-endorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products",),
    ),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software",
        ("without warranty of any kind", "merchantability fitness for a particular purpose"),
    ),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution", ("eclipse public license",)),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software",),
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
        ("person or organization obtaining a copy",),
    ),
    "artistic-2.0": ("this package is free software you can redistribute it and or modify it under the terms of the artistic license version 2 0", ("artistic license",)),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    "cc-by-sa-notice": ("this work is licensed under a creative commons attribution sharealike international license", ("attribution sharealike",)),
    "cc-by-nc-notice": ("this work is licensed under a creative commons attribution noncommercial international license", ("attribution noncommercial",)),
    "ofl": ("this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at", ("sil open font license",)),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed",)),
}
#: Share of the templates that a rare word is in at most; words by which an alignment may drift; share and least number of a template's rare words that must agree.
RARE, DRIFT, AGREE, LEAST = 0.25, 6, 0.5, 3

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BETWEEN = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of UTF-8 that belong to a word: digits, letters and all that is not ASCII.
IN_WORD = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


class Index:
    def __init__(self, templates=TEMPLATES, base=BASE) -> None:
        self.labels = list(templates)
        self.words = [WORD.findall(text) for text, _ in templates.values()]
        self.phrases = [[tuple(p.split()) for p in must] for _, must in templates.values()]
        seen = Counter(w for words in self.words for w in set(words))
        self.base = [(tuple(p.split()), label) for p, label in base.items()]
        self.first = defaultdict(list)
        for p, label in self.base:
            self.first[p[0]].append((p, label))
        # the index's vocabulary: words of templates with an IDF, and the first words of base phrases
        self.vocabulary = sorted({*seen, *self.first})
        self.number = {w: k for k, w in enumerate(self.vocabulary)}
        self.idf = np.array([math.log((1 + len(self.words)) / seen[w]) if w in seen else 0.0 for w in self.vocabulary])
        postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        for t, words in enumerate(self.words):
            for k, w in enumerate(words):
                postings[self.number[w]].append((t, k))
        self.postings = [np.array(p, np.int64).reshape(-1, 2) for p in postings]
        # a rare word has the IDF of one in RARE of the templates, or a higher one
        self.rare = self.idf >= math.log((1 + len(self.words)) / max(1.0, RARE * len(self.words)))
        self.sizes = np.where(self.rare, [len(p) for p in self.postings], 0)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.concatenate([np.zeros((0, 2), np.int64), *(p for p, r in zip(self.postings, self.rare, strict=True) if r)])
        held = Counter(t for p, r in zip(self.postings, self.rare, strict=True) if r for t in set(p[:, 0].tolist()))
        self.held = np.array([held[t] for t in range(len(self.words))], np.int64)
        self.need = np.maximum(LEAST, np.ceil(AGREE * self.held).astype(np.int64))
        self.opens = np.array([w in self.first for w in self.vocabulary])

    def scan_all(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, str]], set[str], float]]:
        """Of each text: the number of words, base places (first word, label), the method's labels, and the best agreement."""
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        known = np.array([-1 if w else -2 for w in distinct], np.int64)  # -2: the empty piece before or behind a separator
        for k, w in enumerate(distinct):
            if w in self.number:
                known[k] = self.number[w]
        codes = flat.indices.to_numpy(zero_copy_only=False)
        number = known[codes]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = number > -2
        place = np.cumsum(real) - 1
        words_before = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], ends])]
        hits = np.flatnonzero(number >= 0)
        of = np.searchsorted(ends, hits, side="right")
        at, words = place[hits] - words_before[of], number[hits]
        sizes = np.diff(words_before)
        file_codes = lambda k: codes[(ends[k - 1] if k else 0) : ends[k]][real[(ends[k - 1] if k else 0) : ends[k]]]
        bases: dict[int, list[tuple[int, str]]] = defaultdict(list)
        opens = np.flatnonzero(self.opens[words])
        for k in np.unique(of[opens]).tolist():
            own = opens[of[opens] == k] if len(ends) < 8 else opens[np.searchsorted(of[opens], k) : np.searchsorted(of[opens], k, side="right")]
            real_codes = file_codes(k)
            bases[k] = self._stand(lambda j, c=real_codes: distinct[c[j]], int(sizes[k]), at[own], words[own])
        labels: dict[int, set[str]] = defaultdict(set)
        best: dict[int, float] = defaultdict(float)
        now, real_codes = -1, None
        for k, t, start, share in self._aligned(of, at, words, int(sizes.max(initial=0))):
            if self.labels[t] in labels[k] and share <= best[k]:
                continue
            if k != now:
                now, real_codes = k, file_codes(k)
            if self._verified(lambda j, c=real_codes: distinct[c[j]], int(sizes[k]), t, start):
                labels[k].add(self.labels[t])
                best[k] = max(best[k], share)
        return [(int(sizes[k]), bases[k], labels[k], best[k]) for k in range(len(ends))]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], set[str], float]:
        return self.scan_all(pa.array([text], pa.string()))[0]

    def _stand(self, word, n: int, at: np.ndarray, words: np.ndarray) -> list[tuple[int, str]]:
        opens = self.opens[words]
        return [(j, label) for j, w in zip(at[opens].tolist(), words[opens].tolist(), strict=True) for p, label in self.first[self.vocabulary[w]] if j + len(p) <= n and all(word(j + i) == x for i, x in enumerate(p))]

    def _aligned(self, of: np.ndarray, at: np.ndarray, words: np.ndarray, longest: int) -> Iterator[tuple[int, int, int, float]]:
        """(file, template, beginning, share of the template's rare words that agree on it) of all places where enough do, file by file."""
        rare = self.rare[words]
        of, at, words = of[rare], at[rare], words[rare]
        n = self.sizes[words]
        hit = np.repeat(np.arange(len(words)), n)
        posting = self.flat[self.starts[words][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
        # a cell of beginnings, and the one before it, so that a drift across a border is not lost; a word counts once in a cell
        shift = max(map(len, self.words)) // DRIFT + 2
        span = longest // DRIFT + shift + 2
        cell = (of[hit] * len(self.words) + posting[:, 0]) * span + (at[hit] - posting[:, 1]) // DRIFT + shift
        own = words[hit]
        both = np.unique(np.concatenate([cell, cell - 1]) * len(self.vocabulary) + np.concatenate([own, own]))
        found, agreed = np.unique(both // len(self.vocabulary), return_counts=True)
        t = found // span % len(self.words)
        for cell, t, count in zip(*(x[agreed >= self.need[t]].tolist() for x in (found, t, agreed)), strict=True):
            yield cell // span // len(self.words), t, (cell % span - shift) * DRIFT, count / int(self.held[t])

    def _verified(self, word, n: int, t: int, start: int) -> bool:
        low, high = max(0, start - 2 * DRIFT), min(n, start + len(self.words[t]) + 4 * DRIFT)
        window = [word(j) for j in range(low, high)]
        return all(any(tuple(window[k : k + len(p)]) == p for k in range(len(window))) for p in self.phrases[t])


@lru_cache(maxsize=1)
def index() -> Index:
    return Index()


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the largest share of a template's rare words that agree, 0 without a label.
    A null text counts as empty: no words, null first_word and last_word, empty labels. Repeated rows and null ids come back as they are;
    other columns, whatever their names, are ignored; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, texts in text_slices(batch):
                rows = []
                for n, places, more, best in index().scan_all(texts):
                    starts, base = [k for k, _ in places], {label for _, label in places}
                    rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([source.column(0), *columns], names=names)

    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
