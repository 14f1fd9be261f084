"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Distances are in words (lower-cased runs of letters and digits), at most int(``rate`` * words) of the item's.

1. Every place of every text begins a window of each item's size. CGK random-walk embedding turns
   a window into a longer word sequence: a step copies the current word and moves on or stays, as a
   random function of step and word says. Edit distance becomes Hamming distance. A walk from one place
   is the same for windows of all sizes up to their end, so all places walk at once, step by step.
2. Bit-sampling LSH, repeated: each of ``walks`` walks has ``tables`` tables of ``bits`` sampled
   steps for each class of item sizes, over all of the item's length; windows that agree with an item in
   all steps of one table are candidates. Steps are compared in order, and windows without an
   item's word at one are not looked at further. No other test selects candidates.
3. Candidates are verified: the least edit distance of the item to any part of the candidate
   windows and their surroundings, by dynamic programming.

At the largest distance allowed about 0.7 of the steps agree; tests measure recall against brute
force. Items of over ``longest`` words are embedded in parts: if the item is within its edits,
one of its m parts is within an m-th of them. Items of fewer than five words allow no edit; their
windows are compared by their first word, and verified.

Items are sent to the tasks as an index, built once for each chunk of at most ``chunk_words`` words, so
what is broadcast is bounded and no more than one chunk is held by the driver; documents stream past
each chunk and are not shuffled.

Defined results: null or empty texts and items match nothing; repeated items each report; of
several matches of one item in a document the closest is reported, then the first; a document row
that is repeated is reported for each row; a very long text makes one slice, and is searched whole;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.words import ALNUM, Slice, mix, slices

SCHEMA = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"
_U = np.uint64
#: Item sizes that share sampled steps: below so many times the smallest of the class. Classes are the same for every benchmark.
CLASS = 1.5
#: Steps are sampled from every fourth (every one, for classes of few words).
GRAIN, FEW = 4, 12
#: Steps are sampled up to so many times the smallest size; a walk moves on at every other step, so most end inside.
REACH = 1.6


def edits_allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def moves(hashes: np.ndarray, walk: int, block: int) -> np.ndarray:
    """A byte for each word: its bits say at which of the steps 8 * block to 8 * block + 7 a walk moves on from the word."""
    x = mix(hashes + _U(((walk << 20) + block // 8 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (x >> _U(8 * (block % 8))).astype(np.uint8)


def bit(move: np.ndarray, step: int) -> np.ndarray:
    return (move >> np.uint8(step & 7)) & np.uint8(1)


def _then(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How far a walk goes from each word by a, which is at most ``most``, and then by b."""
    out = np.zeros_like(a)
    for k in range(most + 1):
        out[: len(a) - k] |= b[k:] & -(a[: len(a) - k] == k).view(np.uint8)
    return a + out


def strides(hashes: np.ndarray, walk: int, steps: int, grain: int) -> Iterator[np.ndarray]:
    """For every ``grain`` steps: how far a walk goes in them from each word."""
    for j in range(0, steps, grain):
        if j % 8 == 0:
            move = moves(hashes, walk, j // 8)
        if grain == 1:
            yield bit(move, j)
        else:
            yield _then(_then(bit(move, j), bit(move, j + 1), 1), _then(bit(move, j + 2), bit(move, j + 3), 1), 2)


def embed(words: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The place among the words that each step of the walk copies; len(words): beyond the end."""
    at, out = 0, np.full(steps, len(words))
    for j in range(steps):
        if j % 8 == 0:
            move = moves(words, walk, j // 8)
        if at >= len(words):
            break
        out[j] = at
        at += int(bit(move, j)[at])
    return out


def smallest(n: int) -> int:
    """The smallest size of the class of n; small sizes are classes of their own."""
    low = min(n, FEW)
    while low >= FEW and int(low * CLASS) <= n:
        low = int(low * CLASS)
    return low


class Table:
    """Sampled steps of one walk for a class of sizes, and what items have there."""

    def __init__(self, steps: list[int], parts: list[tuple[int, list[int]]], codes: int):
        """parts: (part, its word codes at the steps)."""
        self.steps = steps
        self.some = np.zeros((len(steps), codes), bool)
        self.found: dict[tuple, list[int]] = {}
        for part, own in parts:
            self.some[np.arange(len(steps)), own] = True
            self.found.setdefault(tuple(own), []).append(part)


class Index:
    """Items, and the LSH tables of all walks."""

    def __init__(self, ids: list, texts: list, rate: float, walks: int, tables: int, bits: int, longest: int):
        self.ids, self.words, self.edits = [], [], []
        for s in slices(pa.array(texts, pa.large_string()), ALNUM):
            h = s.hashes()
            for i in range(s.n):
                w = h[s.words[i] : s.words[i + 1]]
                if len(w):
                    self.ids.append(ids[s.first + i])
                    self.words.append(w)
                    self.edits.append(edits_allowed(len(w), rate))
        self.sets = [set(w.tolist()) for w in self.words]
        self.known = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.known & _U(0xFFFFF)] = True
        self.parts: list[tuple[int, int, int]] = []  # (item, first word, words)
        for item, w in enumerate(self.words):
            edge = np.linspace(0, len(w), -(-len(w) // longest) + 1).astype(int).tolist()
            self.parts += [(item, a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.tables: dict[tuple[int, int], list[Table]] = {}  # by walk and grain
        classes: dict[int, list[int]] = {}
        for k, (_, _, n) in enumerate(self.parts):
            classes.setdefault(smallest(n), []).append(k)
        for low, own in sorted(classes.items()):
            self._sample(own, low, walks, tables, bits)

    def _sample(self, own: list[int], low: int, walks: int, tables: int, bits: int) -> None:
        codes = len(self.known) + 1
        words = [self.words[i][a : a + n] for i, a, n in (self.parts[k] for k in own)]
        code = [np.searchsorted(self.known, w) + 1 for w in words]
        if low < 5:
            self.tables.setdefault((0, 1), []).append(Table([0], [(k, [int(c[0])]) for k, c in zip(own, code, strict=True)], codes))
            return
        reach, grain = int(REACH * low), GRAIN if low >= FEW else 1
        for walk in range(walks):
            at = [embed(w, walk, reach) for w in words]
            rng = np.random.Generator(np.random.PCG64([low, walk]))
            for _ in range(tables):
                steps = np.sort(rng.choice(np.arange(0, reach, grain), bits, replace=False))
                inside = [(k, c[x[steps]].tolist()) for k, c, x, w in zip(own, code, at, words, strict=True) if x[steps[-1]] < len(w)]
                self.tables.setdefault((walk, grain), []).append(Table(steps.tolist(), inside, codes))

    def _codes(self, h: np.ndarray) -> np.ndarray:
        """The number of each word among the items' words, or 0."""
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.low[h & _U(0xFFFFF)])
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        same = self.known[at] == h[maybe]
        out[maybe[same]] = at[same] + 1
        return out

    def candidates(self, h: np.ndarray) -> dict[int, set[int]]:
        """By part: the places whose windows agree with it in all steps of a table."""
        found: dict[int, set[int]] = {}
        n, longest = len(h), max((t.steps[-1] + 1 for ts in self.tables.values() for t in ts), default=0)
        code = np.zeros(n + longest, np.int64)
        code[:n] = self._codes(h)
        padded = np.zeros(n + longest, np.uint64)
        padded[:n] = h
        for (walk, grain), tables in self.tables.items():
            due: dict[int, list[tuple]] = {}  # step -> (table, how many steps agree, places, their codes so far)
            for t in tables:
                due.setdefault(t.steps[0], []).append((t, 0, None, ()))
            at = np.arange(n)
            for j, stride in zip(range(0, longest, grain), strides(padded, walk, longest, grain), strict=True):
                now = due.pop(j, [])
                here = code.take(at) if any(not x[1] for x in now) else None
                for t, k, places, seen in now:
                    if places is None:
                        places = np.flatnonzero(t.some[0].take(here))
                        got = here[places]
                    else:
                        got = code.take(at[places])
                        keep = np.flatnonzero(t.some[k].take(got))
                        places, got, seen = places[keep], got[keep], [x[keep] for x in seen]
                    if not len(places):
                        continue
                    if k + 1 < len(t.steps):
                        due.setdefault(t.steps[k + 1], []).append((t, k + 1, places, [*seen, got]))
                        continue
                    for place, own in zip(places.tolist(), zip(*(x.tolist() for x in (*seen, got)), strict=True), strict=True):
                        for part in t.found.get(own, ()):
                            found.setdefault(part, set()).add(place)
                if not due:
                    break
                at += stride.take(at)
        return found

    def matches(self, s: Slice) -> list[tuple[int, int, int, int, int]]:
        """(text in the slice, item, distance, first word, word after) of verified matches, the best of each."""
        if not self.parts or not len(s.starts):
            return []
        h = s.hashes()
        windows: dict[tuple[int, int], set[int]] = {}
        for part, places in self.candidates(h).items():
            item, first, _ = self.parts[part]
            places = np.array(sorted(places))
            for d, p in zip((np.searchsorted(s.words, places, "right") - 1).tolist(), places.tolist(), strict=True):
                windows.setdefault((d, item), set()).add(p - first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (d, item), starts in windows.items():
            word, k = self.words[item], self.edits[item]
            low, high, n = int(s.words[d]), int(s.words[d + 1]), len(word)
            if not k:
                for x in sorted(starts):
                    if low <= x and x + n <= high and (h[x : x + n] == word).all():
                        best[d, item] = (0, x - low, x + n - low)
                        break
                continue
            spans: list[list[int]] = []
            for x in sorted(starts):
                a, b = max(x - k, low), min(x + n + k, high)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                elif a < b:
                    spans.append([a, b])
            for a, b in spans:
                if sum(x in self.sets[item] for x in h[a:b].tolist()) < n - k:  # of an item within k edits, all but k words are there
                    continue
                got = closest(word, h[a:b])
                if got[0] <= k and ((d, item) not in best or got[0] < best[d, item][0]):
                    best[d, item] = (got[0], got[1] + a - low, got[2] + a - low)
        return [(d, item, *x) for (d, item), x in sorted(best.items())]


def _last_row(item: np.ndarray, text: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Edit distances of the item to what ends at each place of text, from the distances of an empty item."""
    place = np.arange(len(text) + 1)
    for w in item:
        cost = row + 1
        cost[1:] = np.minimum(cost[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(cost - place) + place
    return row


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text that is closest to item: the earliest end, then the shortest part."""
    row = _last_row(item, text, np.zeros(len(text) + 1, np.int64))
    end = int(row.argmin())
    back = _last_row(item[::-1], text[:end][::-1], np.arange(end + 1))
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end


def _indexes(items: DataFrame, item_col: str, text_col: str, chunk_words: int, **options) -> Iterator[Broadcast]:
    """The benchmark, the stated query set, as broadcast indexes of chunks that are bounded in words."""
    ids, texts, size = [], [], 0
    sc = items.sparkSession.sparkContext
    for r in items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).orderBy("item", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len((r[1] or "").split()) + 1
        if size >= chunk_words:
            yield sc.broadcast(Index(ids, texts, **options))
            ids, texts, size = [], [], 0
    if ids:
        yield sc.broadcast(Index(ids, texts, **options))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.2,
    walks: int = 4,
    tables: int = 8,
    bits: int = 3,
    longest: int = 64,
    chunk_words: int = 500_000,
) -> DataFrame:
    """One row per document row and item that it contains (see SCHEMA)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                ids, out = b.column(0).to_pylist(), []
                for s in slices(b.column(1), ALNUM):
                    out += [(ids[s.first + d], index.ids[i], k, len(index.words[i]), x, y) for d, i, k, x, y in index.matches(s)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(6)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return rows.mapInArrow(run, SCHEMA)

    found = [against(x) for x in _indexes(items, item_col, item_text_col, chunk_words, rate=rate, walks=walks, tables=tables, bits=bits, longest=longest)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.2,
    walks: int = 4,
    tables: int = 8,
    bits: int = 3,
    longest: int = 64,
    chunk_words: int = 500_000,
) -> DataFrame:
    """The documents, with all their columns, that contain no item. Each chunk is a filter in passing."""
    place, schema = docs.columns.index(text_col), docs.schema

    def without(kept: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for s in slices(b.column(place), ALNUM):
                    for m in index.matches(s):
                        clean[s.first + m[0]] = False
                yield b.filter(pa.array(clean))

        return kept.mapInArrow(run, schema)

    return reduce(without, _indexes(items, item_col, item_text_col, chunk_words, rate=rate, walks=walks, tables=tables, bits=bits, longest=longest), docs)
