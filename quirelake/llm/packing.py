"""Packing: cost-balanced packing of tokenised documents into fixed-length sequences.

Each task packs the documents of its partition, in blocks of ``block_sequences`` sequences, so
nothing is shuffled and memory is bounded. Documents are cut into whole sequences of ``length``
ids; what is left of each is a piece with the cost ``linear * n + quadratic * n**2`` (attention
stays inside a document). Pieces go, in descending cost, to the sequence of the lowest cost with
room for them. When none has room for a whole piece, it is cut, and its parts go to the
lowest-cost sequences with room. A block fills its sequences completely; what is over is carried
to the next one. At the end of a partition the last ids go to sequences whose sizes are powers
of two, which take no padding.

Ids are those of the ``tokenizers`` file. If the file asks for byte-level pre-tokenisation and plain
merges, and for nothing else (see ``plain``), texts within Latin scripts take a faster way that gives
the same ids: the ids of each pre-token, by the file's merge ranks and a bounded memory. All others, and
all texts of other files, go to ``tokenizers`` itself.

Defined results: a null text is empty; an empty text is its end id alone; a very long text is
cut into as many sequences as it fills; pieces of one cost go by their place in the input, and
sequences of one cost by number; null or repeated ids are packed like any other row; an
empty table gives an empty result; other columns are ignored. Sequence ids are unique over the
table: the partition's number in the upper bits.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
LENGTH = 2048
END_ID = 1
MEMORY = 250_000  # pre-tokens remembered by a worker


#: What a tokenizer file must say for the faster way: byte-level pre-tokenisation by its usual pattern, plain merges.
_PLAIN = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def plain(path: str) -> bool:
    """Whether the file asks for nothing that the faster way does not do."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    # a key that is not there stands for its default, which is false for flags
    return all(
        said.get(part) == want if want is None else isinstance(said.get(part), dict) and all((said[part].get(k) or None) == (v or None) for k, v in want.items())
        for part, want in _PLAIN.items()
    )


class Encoder:
    """Texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.quick = self._merger() if plain(path) else None
        # the pattern of byte-level pre-tokenisation, for texts whose characters all lie in the range that ``beyond`` allows
        letter, number = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
        self.pieces = re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")
        special = [re.escape(x.content) for x in self.exact.get_added_tokens_decoder().values()]
        self.beyond = re.compile("|".join(["[^\t\n\r\x20-\x7e\xa1-ɏ]", *special]))

    def _merger(self):
        """The same vocabulary as merge ranks, for single pre-tokens; None if its ids are not in merge order."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.exact.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        try:
            quick = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            probe = [" the", " erinshnt", "Ciónamente", " éauxtre", "  ", "!!", " 4952", "'s", "\n\n", "ß", " Überprüfung", "&&&###"]
            return quick if all(quick(x) == self.exact.encode(x, add_special_tokens=False).ids for x in probe) else None
        except (ValueError, KeyError):
            return None

    def exactly(self, text: str) -> bytes:
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, piece: str) -> bytes:
        got = np.array(self.quick(piece), "<u4").tobytes()
        if len(self.known) < MEMORY:  # pieces that come first are the frequent ones
            self.known[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.quick is None or self.beyond.search(text):
            return self.exactly(text)
        known, learn = self.known, self.learn
        return b"".join([known.get(p) or learn(p) for p in self.pieces.findall(text)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs pieces of one partition; a piece is (row, start, length)."""

    def __init__(self, first_sequence: int, length: int, linear: float, quadratic: float, block_sequences: int):
        self.next, self.length, self.a, self.b, self.block = first_sequence, length, linear, quadratic, block_sequences
        self.left: list[tuple[int, int, int]] = []
        self.tokens = 0

    def whole(self, row: int, start: int) -> tuple[int, int, int, int, int]:
        self.next += 1
        return (row, start, self.length, self.next - 1, 0)

    def add(self, row: int, start: int, n: int) -> None:
        self.left.append((row, start, n))
        self.tokens += n

    def full(self) -> bool:
        return self.tokens >= self.block * self.length

    def _fill(self, sizes: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
        """Placed pieces (row, start, length, sequence, offset), and those that found no room."""
        room, cost = sizes.astype(np.int64), np.zeros(len(sizes))
        used = np.zeros(len(sizes), np.int64)
        out, over = [], []
        cost_of = lambda n: self.a * n + self.b * n * n
        for row, start, n in sorted(self.left, key=lambda x: (-cost_of(x[2]), x[0], x[1])):
            while n:
                fits = room >= n
                if not fits.any():
                    fits = room > 0
                    if not fits.any():
                        over.append((row, start, n))
                        break
                k = int(np.argmin(np.where(fits, cost, np.inf)))
                part = min(n, int(room[k]))
                out.append((row, start, part, self.next + k, int(used[k])))
                room[k] -= part
                used[k] += part
                cost[k] += cost_of(part)
                start, n = start + part, n - part
        self.next += len(sizes)
        return out, over

    def pack(self) -> list[tuple[int, int, int, int, int]]:
        """Fills as many whole sequences as the pieces at hand allow."""
        n = self.tokens // self.length
        if not n:
            return []
        out, self.left = self._fill(np.full(n, self.length))
        self.tokens = sum(x[2] for x in self.left)
        return out

    def end(self) -> list[tuple[int, int, int, int, int]]:
        out = self.pack()
        sizes = [1 << k for k in reversed(range(self.tokens.bit_length())) if self.tokens >> k & 1]
        if sizes:
            last, self.left = self._fill(np.array(sizes))
            out += last
        self.tokens = 0
        return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_sequences: int = 256,
) -> DataFrame:
    """Pieces of documents and where they lie (see SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33, length, linear, quadratic, block_sequences)
        held: dict[int, tuple] = {}  # row -> (doc id, ids)
        end = np.array([end_id], "<u4").tobytes()

        def emit(placed: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            rows = [
                (held[r][0], s, n, zlib.crc32(held[r][1][4 * s : 4 * (s + n)]), len(held[r][1]) // 4, q, o)
                for r, s, n, q, o in placed
            ]
            for r in {x[0] for x in placed} - {x[0] for x in packer.left}:
                del held[r]
            cols = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        row = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                held[row] = (doc_id, ids)
                n = len(ids) // 4
                cut = n - n % length
                if cut:
                    wholes = [packer.whole(row, s) for s in range(0, cut, length)]
                    if n > cut:
                        packer.add(row, cut, n - cut)
                    yield emit(wholes)
                else:
                    packer.add(row, 0, n)
                row += 1
                if packer.full():
                    yield emit(packer.pack())
        yield emit(packer.end())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
