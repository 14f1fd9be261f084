"""License scans: an exact set-similarity join of text blocks with licence templates.

Texts are lower-cased in A-Z; words are runs of letters and digits. A block is a line, or where a
line is longer than the block size, each window of so many words at every half of it. The size goes by
the template: ``block_words``, doubled until it is twice the template's words, so any place of the
template's length lies inside a block whole. With ``wrapped``, which the query sets, the windows over the words of the whole text are
blocks too, so that a notice wrapped at line ends lies inside one.

A block matches a template if it has at least ``percent`` of the template's distinct words:

1. The words of all templates (a bounded vocabulary) are counted over the whole table; their
   global frequency, rarest first, orders each template's words.
2. Prefix filter: a block that meets the threshold has one of the template's first
   n - needed + 1 words in that order. Only these words generate candidates.
3. Length filter: the block has at least as many distinct words of the vocabulary as needed.
   Positional filter: what remains of both after the first common word can still reach it.
4. The overlap is counted exactly.

Beside the templates, phrases (see PHRASES) are found wherever their words stand consecutively.

Defined results: null and empty texts have no words; words of equal frequency are ordered by their
letters; repeated rows are reported each; a very long text is scanned whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.words import ALNUM, Slice, slices

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by which licences are commonly declared, and paragraphs of their texts (fixed values).
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope"
        " that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,end:long,containment:double>>"
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


class Vocabulary:
    """The words of templates and phrases, by number."""

    def __init__(self, templates: list, phrases: dict):
        self.words = sorted({w for t in [*(t for _, t in templates), *phrases] for w in t.split()})
        hashes = np.concatenate([s.hashes() for s in slices(pa.array(self.words, pa.large_string()), ALNUM)])
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}

    def look_up(self, s: Slice) -> np.ndarray:
        """The number of each word of a slice, or -1."""
        h = s.hashes()
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def frequencies(docs: DataFrame, text_col: str, templates: list, phrases: dict) -> dict[int, int]:
    """How often each word of the vocabulary occurs in all texts. One row per word and task is summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(templates, phrases)
        total = np.zeros(len(vocabulary.words), np.int64)
        for b in batches:
            for s in slices(b.column(0), ALNUM):
                got = vocabulary.look_up(s)
                total += np.bincount(got[got >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    return dict(docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect())


class Scanner:
    def __init__(self, templates: list, phrases: dict, percent: int, block_words: int, count: dict[int, int], wrapped: bool = False):
        self.vocabulary = Vocabulary(templates, phrases)
        number, words = self.vocabulary.number, self.vocabulary.words
        place = sorted(range(len(words)), key=lambda i: (count.get(i, 0), words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[place] = np.arange(len(words))
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases.items()]
        self.templates, self.prefixes = [], {}
        for label, text in templates:
            t = sorted({int(self.rank[number[w]]) for w in text.split()})
            needed = -(-percent * len(t) // 100)
            block = block_words
            while block < 2 * len(text.split()):
                block *= 2
            for i, r in enumerate(t[: len(t) - needed + 1]):
                self.prefixes.setdefault(r, {}).setdefault(block, []).append((len(self.templates), i))
            self.templates.append((label, t, needed))
        self.starts = np.zeros(len(words), bool)
        self.starts[list(self.prefixes)] = True
        self.wrapped = wrapped

    @staticmethod
    def windows(start: int, end: int, at: int, block: int) -> list[tuple[int, int]]:
        """The blocks of a line or text (words start..end-1) that hold the word at."""
        if end - start <= block:
            return [(start, end)]
        half = block // 2
        k = (at - start) // half
        return [(start + j * half, min(start + j * half + block, end)) for j in (k - 1, k) if j >= 0 and (j == 0 or start + j * half + half < end)]

    def scan(self, s: Slice) -> tuple[dict[int, list], dict[int, dict]]:
        """By text of the slice: (start word, label) of phrases; best containment by (label, block)."""
        n = self.vocabulary.look_up(s)
        base: dict[int, list] = {}
        for phrase, label in self.phrases:
            at = np.flatnonzero(n == phrase[0])
            for k, w in enumerate(phrase[1:], 1):
                at = at[at + k < len(n)]
                at = at[n[at + k] == w]
            doc = np.searchsorted(s.words, at, "right") - 1
            inside = at + len(phrase) <= s.words[doc + 1] if len(at) else np.zeros(0, bool)
            for d, a in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                base.setdefault(d, []).append((a - int(s.words[d]), label))
        rank = np.where(n >= 0, self.rank[n], -1)
        first = np.flatnonzero((rank >= 0) & self.starts[rank])
        lines = np.flatnonzero(s.data == 10)
        found: dict[int, dict] = {}
        done, known = set(), {}
        for at in first.tolist():
            d = int(np.searchsorted(s.words, at, "right")) - 1
            k = int(np.searchsorted(lines, s.starts[at]))
            low = max(int(s.words[d]), int(np.searchsorted(s.starts, lines[k - 1])) if k else 0)
            high = min(int(s.words[d + 1]), int(np.searchsorted(s.starts, lines[k])) if k < len(lines) else len(n))
            for block, prefixes in self.prefixes[int(rank[at])].items():
                blocks = self.windows(low, high, at, block)
                if self.wrapped:
                    blocks = dict.fromkeys([*blocks, *self.windows(int(s.words[d]), int(s.words[d + 1]), at, block)])
                for a, b in blocks:
                    own = None
                    for t, i in prefixes:
                        if (a, b, t) in done:
                            continue
                        label, words, needed = self.templates[t]
                        if own is None:
                            own = known.get((a, b))
                            if own is None:
                                own = np.unique(rank[a:b])
                                own = known[a, b] = own[own >= 0]
                        if len(own) < needed:  # length
                            continue
                        if min(len(words) - i, len(own) - int(np.searchsorted(own, rank[at]))) < needed and not any(r in own for r in words[:i]):  # position
                            continue
                        done.add((a, b, t))
                        same = len(np.intersect1d(own, words, assume_unique=True))
                        if same >= needed:
                            where = (label, a - int(s.words[d]), b - int(s.words[d]))
                            mine = found.setdefault(d, {})
                            mine[where] = max(mine.get(where, 0.0), same / len(words))
        return base, found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list = TEMPLATES, phrases: dict = PHRASES, percent: int = 80, block_words: int = 64, wrapped: bool = False) -> DataFrame:
    """One row per document: base places, labels, best containment and the matching blocks."""
    count = frequencies(docs, text_col, templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, percent, block_words, count, wrapped)
        for b in batches:
            out = []
            for s in slices(b.column(1), ALNUM):
                base, found = scanner.scan(s)
                for i, words in enumerate(s.counts().tolist()):
                    own, blocks = base.get(i, []), found.get(i, {})
                    mine = {x[1] for x in own}
                    out.append((
                        words, len(own), min((x[0] for x in own), default=None), max((x[0] for x in own), default=None),
                        ",".join(sorted(mine)), ",".join(sorted(mine | {x[0] for x in blocks})),
                        1.0 if own else max(blocks.values(), default=0.0),
                        [{"label": k[0], "start": k[1], "end": k[2], "containment": v} for k, v in sorted(blocks.items())],
                    ))
            cols = list(zip(*out, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _BLOCKS]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
