"""Blocks of documents, and their exchange of sorted hash arrays with shards of the hash space.

A block is a run of consecutive rows of the input, of some megabytes of text. It travels as one
row: a compressed Arrow table in a binary column. Rows that are repeated in a block are held once,
with their number, so a row that fills a third of the table is hashed once a block.

A block turns its hashes into one sorted array. Shards are ranges of the hash space, so a block's
part for a shard is a slice of that array: it travels as one row with a compact binary column
instead of a row per hash. A shard's answer is an array in the same order, and a block puts the
answers of all shards together by their order.

Rows exchanged are blocks x shards; both are the text's bytes over ``block_bytes``, which grows with
the corpus from 6 to 128 MB (README: memory of a block, and rows at 100 TB). A block that is computed
again after a loss holds the same rows, as files are read in the same order; should an input not
be repeatable, the block's mark shows that, and the query fails instead of mixing two versions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.words import _buffers

#: Bits of the sorted key of windows, which have more bits beside it.
KEY_BITS = 48
#: Rows of a block at most, however short their texts are.
BLOCK_ROWS = 100_000
_U = np.uint64


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; one column is read and one number comes back."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def block_size(total: int, least: int = 6 << 20, most: int = 128 << 20) -> int:
    """Bytes of a block: some thousands of blocks, as long as they stay below ``most``."""
    return max(least, min(most, total // 4000))


def plan(total: int) -> int:
    """Blocks (and shards) for so many bytes."""
    return max(8, -(-total // block_size(total)))


def _runs(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows with at most ``size`` bytes of text (more, if one text has more)."""
    held: list[pa.RecordBatch] = []
    used = rows = 0
    for b in batches:
        off, _ = _buffers(b.column(text))
        i, n = 0, b.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + size - used, "right")) - 1
            j = min(max(j, i if held else i + 1), i + BLOCK_ROWS - rows, n)
            if j > i:
                held.append(b.slice(i, j - i))
                used, rows = used + int(off[j] - off[i]), rows + j - i
            if j < n:
                yield pa.Table.from_batches(held)
                held, used, rows = [], 0, 0
            i = j
    if held:
        yield pa.Table.from_batches(held)


def blocked(docs: DataFrame, columns: list, size: int, partitions: int, text: str = "text") -> DataFrame:
    """(block, data): the columns in blocks, with ``copies`` for repeated rows, dealt to so many partitions."""
    rows = docs.select(*columns)
    names, place = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        block = TaskContext.get().partitionId() << 32
        for t in _runs(batches, place, size):
            if pc.count_distinct(t.column(0), "all").as_py() < t.num_rows:
                t = t.group_by(names, use_threads=False).aggregate([([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "copies"])
            else:
                t = t.append_column("copies", pa.array(np.ones(t.num_rows, np.int64)))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema, options=options) as to:
                to.write_table(t.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])
            block += 1

    return rows.mapInArrow(run, "block long, data binary").repartition(partitions, "block")


def opened(table: pa.Table) -> pa.Table:
    """The rows of the one block that a group holds."""
    return pa.ipc.open_stream(table.column("data")[0].as_buffer()).read_all()


def copies(table: pa.Table) -> np.ndarray:
    return table.column("copies").to_numpy()


def repeated(out: pa.Table, table: pa.Table) -> pa.Table:
    """Rows that the block holds once come out as often as they are in the input."""
    n = copies(table)
    return out if (n == 1).all() else out.take(pa.array(np.repeat(np.arange(len(n)), n)))


def mark(keys: np.ndarray) -> int:
    """Tells versions of a block apart by its keys."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(keys).view(np.uint8)) >> 1


def same_block(keys: np.ndarray, answers: pa.Table, column: str = "mark") -> None:
    got = set(answers.column(column).to_pylist()) - {None}
    if got - {mark(keys)}:
        raise RuntimeError("a block was computed again with other rows: the input is not repeatable")


def key_bits(total: int, spare: int) -> int:
    """Bits of a key by which texts of so many bytes can be told apart, with so many to spare over the number of words."""
    return min(62, max(32, math.ceil(math.log2(total / 4 + 1)) + spare))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which of them each value is."""
    order = np.argsort(x)
    there = x[order]
    new = np.ones(len(x), bool)
    new[1:] = there[1:] != there[:-1]
    at = np.flatnonzero(new)
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return there[at], order[at], which


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys, as gaps of as many bytes as the widest takes: the width, the first key, the gaps."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    some = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[0])
    out = np.zeros(len(some) + 1, "<u8")
    out.view(np.uint8).reshape(-1, 8)[1:, : blob[0]] = some
    out[0] = np.frombuffer(blob, "<u8", 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def cuts(keys: np.ndarray, shards: int, bits: int = KEY_BITS) -> np.ndarray:
    """shards + 1 places at which sorted keys pass to the next shard."""
    edges = np.array([(i << bits) // shards for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def spans(keys: np.ndarray, shards: int, bits: int = KEY_BITS, every: bool = False) -> list[tuple[int, int, int]]:
    """(shard, first, after) of the shards that get some of the sorted keys, or of every shard."""
    at = cuts(keys, shards, bits)
    some = np.arange(shards) if every else np.flatnonzero(np.diff(at))
    return list(zip(some.tolist(), at[some].tolist(), at[some + 1].tolist(), strict=True))


def pack(values: np.ndarray) -> bytes:
    """Counts: a byte each, compressed (most are alike); those of 255 and more follow in full."""
    small = np.minimum(values, 255).astype(np.uint8)
    tight = pa.compress(small.tobytes(), "zstd", asbytes=True) if len(small) > 32 else small.tobytes()
    return np.array([len(small), len(tight)], np.uint32).tobytes() + tight + values[small == 255].astype("<u8").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n, size = np.frombuffer(blob, np.uint32, 2).tolist()
    if not n:
        return np.zeros(0, np.int64)
    tight = blob[8 : 8 + size]
    out = np.frombuffer(pa.decompress(tight, n, "zstd", asbytes=True) if n > 32 else tight, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=8 + size).astype(np.int64)
    return out
