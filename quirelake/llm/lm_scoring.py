"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark.

All counting covers every training text, and no part of the model is held whole by any task:

1. Each block of documents sends the sorted hashes of its distinct trigrams, with their training
   counts, to shards of the hash space.
2. A shard sums them up. Its part of the model is a file of sorted hash arrays which the worker
   maps into memory and searches for each block; it answers with the totals, and for each trigram
   which block owns it (the first that trained on it), so that it is counted once from here on.
3. Each block sums what it owns by the trigrams' last two words (distinct left contexts, the
   counts of the middle order) and by their first two (totals and numbers of continuations seen
   once, twice and more often), and sends that to shards of the bigrams, which again keep sorted
   hash arrays, answer, and name an owner.
4. The same from bigrams to words, along with the words' plain counts.
5. Each block scores its texts. Discounts come from the counts of counts of all shards.

With ``store`` the files stay in that folder, which all workers must see: the model, to score any
other texts by (see perplexity). Without it a file goes when its shard has answered.

Words are identified by 64-bit hashes, n-grams by as many bits as make a wrong match of one that was
not seen less likely than 2**-12 (``key_bits``). A text begins with two start marks.

Defined results: a null text is empty and has the end token alone; unknown words get the model's
unknown-word mass; with no training text every score is 0; an empty table gives an empty result; a
very long text is a block of its own; repeated rows count as often as they occur and are scored
each; ties do not arise; rows with a null id are training rows unless the condition says otherwise;
other columns are ignored.
"""

from __future__ import annotations

import contextlib
import glob
import os
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm import blobs
from quirelake.llm.words import SPACED, mix, slices

END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x27D4EB2F165667C5)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
_ROWS = "shard int, block long, kind int, mark long, keys binary, a binary, b binary, c binary, d binary, e binary, f binary, sums array<long>"
_NAMES = ["shard", "block", "kind", "mark", "keys", "a", "b", "c", "d", "e", "f", "sums"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 7 + [pa.list_(pa.int64())]
TRIGRAM, BIGRAM, WORD = 3, 2, 1
_WORD_BITS = 64
_U = np.uint64


def _table(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)})


class HashArrays:
    """Sorted hashes with columns of counts, in a file that is mapped into memory: a head of int64 (number
    of hashes, of columns, of sums, and the sums), the hashes, then each column."""

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, 3)
        self.n, columns, sums = head.tolist()
        self.sums = np.fromfile(path, np.int64, sums, offset=24)
        at = 24 + 8 * sums
        if self.n:
            self.keys = np.memmap(path, np.uint64, "r", at, (self.n,))
            self.columns = [np.memmap(path, np.uint32, "r", at + 8 * self.n + 4 * self.n * i, (self.n,)) for i in range(columns)]
        else:
            self.keys, self.columns = np.zeros(0, np.uint64), [np.zeros(0, np.uint32) for _ in range(columns)]

    @staticmethod
    def write(path: str, keys: np.ndarray, columns: list[np.ndarray], sums: list[int]) -> None:
        if any(len(c) and c.max() >= 1 << 32 for c in columns):
            columns = [np.minimum(c, (1 << 32) - 1) for c in columns]  # counts over four thousand million do not change a score
        with open(path + ".part", "wb") as out:
            out.write(np.array([len(keys), len(columns), len(sums), *sums], np.int64).tobytes())
            out.write(keys.tobytes())
            for c in columns:
                out.write(c.astype(np.uint32).tobytes())
        os.replace(path + ".part", path)  # whole or not at all, also if two attempts of a task write it

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where keys lie, or n where they are not."""
        at = np.searchsorted(self.keys, keys)
        if not self.n:
            return at
        return np.where(self.keys[np.minimum(at, self.n - 1)] == keys, at, self.n)


@contextlib.contextmanager
def _part(store: str | None, order: int, shard: int) -> Iterator[str]:
    """The file of a shard: kept in the store, or a scratch file of this task."""
    if store:
        yield os.path.join(store, f"{order}-{shard:08d}.hashes")
    else:
        with tempfile.TemporaryDirectory() as own:
            yield os.path.join(own, "hashes")


def _merged(keys: list[np.ndarray], columns: Iterator[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and the sums of their columns."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")  # of sorted runs
    every = every[order]
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[at], [np.add.reduceat(c[order], at) if len(at) else np.zeros(0, np.int64) for c in columns]


class Block:
    """Tokens of a block: hashes of the words, of pairs and of triples of words, and their places among the distinct ones."""

    def __init__(self, table: pa.Table, bits: int):
        self.shift = _U(64 - bits)
        hashes, sizes = [], []
        for s in slices(table.column("text"), SPACED):
            h = np.empty(len(s.starts) + s.n, np.uint64)
            h[np.arange(len(s.starts)) + s.doc_of()] = s.hashes()
            h[s.words[1:] + np.arange(s.n)] = END
            hashes.append(h)
            sizes.append(s.counts() + 1)
        self.sizes = np.concatenate(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes  # of each text
        held = table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.weight = np.repeat(np.where(held, 0, blobs.copies(table)), self.sizes)
        # the last token is no token: it makes the start mark a word, and two start marks a bigram
        self.token = np.append(np.concatenate(hashes), START)
        self.pair = mix(np.append(self._shifted(self.token[:-1], START), START) * _U(0x9FB21C651E98DF25) ^ mix(self.token))

    def _shifted(self, x: np.ndarray, start) -> np.ndarray:
        """x of the token before; of a text's first token, start."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return blobs.distinct(self.token)

    @cached_property
    def _bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return blobs.distinct(self.pair >> self.shift)

    @cached_property
    def _trigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = self._shifted(self.pair[:-1], self.pair[-1])
        return blobs.distinct(mix(before * _U(0xD6E8FEB86659FD93) ^ mix(self.token[:-1])) >> self.shift)

    words = property(lambda self: self._words[0])
    bigrams = property(lambda self: self._bigrams[0])
    trigrams = property(lambda self: self._trigrams[0])
    word = property(lambda self: self._words[2][:-1])  # of each token
    bigram = property(lambda self: self._bigrams[2][:-1])  # that ends with each token
    trigram = property(lambda self: self._trigrams[2])
    trigram_at = property(lambda self: self._trigrams[1])  # a token for each distinct trigram

    @cached_property
    def pair_before(self) -> np.ndarray:
        """The bigram before each token."""
        return self._shifted(self.bigram, self._bigrams[2][-1])

    @cached_property
    def of_bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """First and second word of each distinct bigram."""
        at, one = self._words[2], self._bigrams[1]
        return np.append(self._shifted(at[:-1], at[-1]), at[-1])[one], at[one]


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1..4. Where one of them is zero, as in
    very small corpora, fixed discounts stand in."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    got = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(got, 1))


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts after their discount."""
    return np.maximum(count - np.array((0.0, *d))[np.minimum(count, 3)], 0.0)


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def _by(where: np.ndarray, size: int, weights=None) -> np.ndarray:
    return np.bincount(where, weights, size).astype(np.int64)


def _contexts(where: np.ndarray, size: int, count: np.ndarray) -> list[np.ndarray]:
    """By context: the sum of counts, and how many continuations are counted once, twice and more."""
    return [_by(where, size, count), *(_by(where[w], size) for w in (count == 1, count == 2, count >= 3))]


class Probabilities:
    """What the sums over all shards say, and the probabilities of the three orders."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray, word: np.ndarray):
        self.tri, self.bi = discounts(tri[:4]), discounts(bi[:4])
        self.tokens, self.kinds, self.pairs, self.followers, *of = (int(x) for x in word)
        self.low = discounts(np.array(of))
        e = self.low
        self.rest = e[0] * of[0] + e[1] * of[1] + e[2] * (self.followers - of[0] - of[1])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def one(self, seen: np.ndarray) -> np.ndarray:
        """Of words, from the number of distinct words before them; the mass of unknown ones is a share like any other."""
        if not self.pairs:
            return np.ones(len(seen))
        return (_less(seen, self.low) + self.rest / (self.followers + 1)) / self.pairs

    @staticmethod
    def _on(count: np.ndarray, d: tuple, context: list[np.ndarray], below: np.ndarray) -> np.ndarray:
        after, n1, n2, n3 = context
        some = np.maximum(after, 1)
        return np.where(after > 0, _less(count, d) / some + (d[0] * n1 + d[1] * n2 + d[2] * n3) / some * below, below)

    def two(self, count: np.ndarray, context: list[np.ndarray], below: np.ndarray) -> np.ndarray:
        return self._on(count, self.bi, context, below)

    def three(self, count: np.ndarray, context: list[np.ndarray], below: np.ndarray) -> np.ndarray:
        return self._on(count, self.tri, context, below)


def _scored(block: Block, p: Probabilities, tri: np.ndarray, bi: list[np.ndarray], word: list[np.ndarray], table: pa.Table) -> pa.Table:
    """One row per row of the block. tri: totals; bi: left contexts, then the context columns; word: plain counts, context columns, words before."""
    c, seen = word[0], word[5]
    one = p.one(seen)
    two = p.two(bi[0], [x[block.of_bigrams[0]] for x in word[1:5]], one[block.of_bigrams[1]])
    three = p.three(tri, [x[block.pair_before[block.trigram_at]] for x in bi[1:]], two[block.bigram[block.trigram_at]])
    score = np.add.reduceat(np.log10(three)[block.trigram], block.first)
    return blobs.repeated(pa.table({
        "doc_id": table.column("doc_id"),
        "held_out": table.column("held_out"),
        "n_tokens": pa.array(block.sizes.astype(np.int64)),
        "n_known": pa.array(np.add.reduceat((c > 0)[block.word].astype(np.int64), block.first)),
        "train_tokens": pa.array(np.full(len(block.sizes), p.tokens, np.int64)),
        "base_score": pa.array(np.add.reduceat(p.base(c)[block.word], block.first)),
        "score": pa.array(score),
        "perplexity": pa.array(np.power(10.0, np.minimum(-score / block.sizes, 300.0))),
    }), table)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, store: str | None = None) -> DataFrame:
    """Trains on the rows that are not held out, and scores all rows (see SCHEMA)."""
    total = blobs.text_bytes(docs, text_col)
    n = blocks or blobs.plan(total)
    size = max(1, -(-total // n)) if blocks else blobs.block_size(total)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")]
    rows = blobs.blocked(docs, columns, size, n)
    bits = blobs.key_bits(total, 12)
    bits_of = {TRIGRAM: bits, BIGRAM: bits, WORD: 64}
    if store:
        os.makedirs(store, exist_ok=True)
        with open(os.path.join(store, "bits"), "w") as f:
            f.write(str(bits))

    def sent(kind: int, me: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        mark = blobs.mark(keys)
        return _table([
            {"shard": i, "block": me, "kind": kind, "mark": mark, "keys": blobs.encode(keys[a:b]), **{x: blobs.pack(v[a:b]) for x, v in zip("abcdef", columns, strict=False)}}
            for i, a, b in blobs.spans(keys, n, bits_of[kind], every=True)
        ])

    def answered(kind: int, columns: str, owned: str | None, sums):
        """Step of a shard: writes its part of the model, maps it, and answers each block. owned: the column that tells who saw a key."""

        def answer(key: tuple, table: pa.Table) -> pa.Table:
            shard, table = key[0].as_py(), table.sort_by("block")
            keys = [blobs.decode(x) for x in table.column("keys").to_pylist()]
            own = [blobs.unpack(x) > 0 for x in table.column(owned).to_pylist()] if owned else []
            distinct, totals = _merged(keys, (np.concatenate([blobs.unpack(x) for x in table.column(c).to_pylist()]) for c in columns))
            sum_ = sums(totals)
            with _part(store, kind, shard) as path:
                HashArrays.write(path, distinct, totals, sum_)
                del distinct, totals
                model = HashArrays(path)
                free, out = np.ones(model.n, bool), []
                for k, (block, mark) in enumerate(zip(table.column("block").to_pylist(), table.column("mark").to_pylist(), strict=True)):
                    at = model.find(keys[k])
                    row = {"shard": shard, "block": block, "kind": kind, "mark": mark, "sums": sum_, **{x: blobs.pack(v[at].astype(np.int64)) for x, v in zip("abcdef", model.columns, strict=False)}}
                    if owned:
                        mine = own[k] & free[at]
                        free[at[mine]] = False
                        row["f"] = np.packbits(mine).tobytes()
                    out.append(row)
                return _table(out)

        return answer

    def answers(right: pa.Table, kind: int, keys: np.ndarray) -> pa.Table:
        some = right.filter(pa.compute.equal(right.column("kind"), kind)).sort_by("shard")
        blobs.same_block(keys, some)
        return some

    def joined(some: pa.Table, columns: str) -> list[np.ndarray]:
        return [np.concatenate([blobs.unpack(x) for x in some.column(c).to_pylist()]) for c in columns]

    def owned(some: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
        parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=b - a) for x, (_, a, b) in zip(some.column("f").to_pylist(), blobs.spans(keys, n, bits_of[kind], every=True), strict=True)]
        return np.concatenate(parts).astype(bool)

    def summed(some: pa.Table) -> np.ndarray:
        return np.sum(some.column("sums").to_pylist(), axis=0)

    def to_trigrams(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(blobs.opened(table), bits)
        return sent(TRIGRAM, key[0].as_py(), block.trigrams, [_by(block.trigram, len(block.trigrams), block.weight)])

    def to_bigrams(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(blobs.opened(left), bits)
        got = answers(right, TRIGRAM, block.trigrams)
        own = owned(got, TRIGRAM, block.trigrams)
        mine, c, size = block.trigram_at[own], joined(got, "a")[0][own], len(block.bigrams)
        return sent(BIGRAM, key[0].as_py(), block.bigrams, [_by(block.bigram[mine], size), *_contexts(block.pair_before[mine], size, c)])

    def to_words(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(blobs.opened(left), bits)
        got = answers(right, BIGRAM, block.bigrams)
        own = owned(got, BIGRAM, block.bigrams)
        size, a, (before, word) = len(block.words), joined(got, "a")[0][own], block.of_bigrams
        return sent(WORD, key[0].as_py(), block.words, [_by(block.word, size, block.weight), *_contexts(before[own], size, a), _by(word[own], size)])

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = blobs.opened(left)
        block = Block(table, bits)
        tri, bi, word = answers(right, TRIGRAM, block.trigrams), answers(right, BIGRAM, block.bigrams), answers(right, WORD, block.words)
        return _scored(block, Probabilities(summed(tri), summed(bi), summed(word)), joined(tri, "a")[0], joined(bi, "abcde"), joined(word, "abcdef"), table)

    def counted(queries: DataFrame, answer) -> DataFrame:
        # dealt to blocks once, for the next step and the last one
        return queries.groupBy("shard").applyInArrow(answer, _ROWS).repartition(n, "block")

    of = lambda x: x.groupBy("block")
    some = lambda t: _counts_of_counts(t[0])
    every = lambda t: [int(t[0].sum()), int((t[0] > 0).sum()), int(t[5].sum()), int((t[5] > 0).sum()), *_counts_of_counts(t[5])]
    tri = counted(of(rows).applyInArrow(to_trigrams, _ROWS), answered(TRIGRAM, "a", "a", some))
    bi = counted(of(rows).cogroup(of(tri)).applyInArrow(to_bigrams, _ROWS), answered(BIGRAM, "abcde", "a", some))
    word = counted(of(rows).cogroup(of(bi)).applyInArrow(to_words, _ROWS), answered(WORD, "abcdef", None, every))
    return of(rows).cogroup(of(tri.union(bi).union(word))).applyInArrow(finish, SCHEMA)


class StoredModel:
    """A model in a folder: every file is mapped, and the pages that are asked for are read."""

    def __init__(self, store: str):
        self.parts = {k: [HashArrays(x) for x in sorted(glob.glob(f"{store}/{k}-*.hashes"))] for k in (TRIGRAM, BIGRAM, WORD)}
        self.firsts = {k: np.array([x.keys[0] for x in v if x.n], np.uint64) for k, v in self.parts.items()}
        self.parts = {k: [x for x in v if x.n] for k, v in self.parts.items()}
        if not all(self.parts.values()):
            raise ValueError(f"no model in {store}")
        with open(os.path.join(store, "bits")) as f:
            self.bits = int(f.read())
        self.p = Probabilities(*(np.sum([x.sums for x in parts], axis=0) for parts in (self.parts[TRIGRAM], self.parts[BIGRAM], self.parts[WORD])))

    def look_up(self, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """The columns of sorted keys; 0 where the model does not have them."""
        parts = self.parts[kind]
        out = [np.zeros(len(keys), np.int64) for _ in parts[0].columns]
        edge = np.append(np.searchsorted(keys, self.firsts[kind][1:]), len(keys))
        low = 0
        for part, high in zip(parts, edge.tolist(), strict=True):
            at = part.find(keys[low:high])
            some = np.flatnonzero(at < part.n)
            for o, c in zip(out, part.columns, strict=True):
                o[low + some] = c[at[some]]
            low = high
        return out


def perplexity(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of any documents by a stored model (see SCHEMA; all rows are held out). Nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = StoredModel(store)
        for t in blobs._runs(batches, 1, 6 << 20):
            t = t.append_column("held_out", pa.array(np.ones(t.num_rows, bool))).append_column("copies", pa.array(np.ones(t.num_rows, np.int64)))
            block = Block(t, model.bits)
            tri, bi, word = (model.look_up(k, x) for k, x in ((TRIGRAM, block.trigrams), (BIGRAM, block.bigrams), (WORD, block.words)))
            yield from _scored(block, model.p, tri[0], bi, word, t).combine_chunks().to_batches()

    return rows.mapInArrow(run, SCHEMA)
