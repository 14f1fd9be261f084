"""Substring dedup: repeated windows of words, by Rabin-Karp hashes counted in Spark.

1. Each block of documents hashes every window of ``window`` words and sends its distinct hashes,
   sorted, with whether the block holds one more than once, to shards of the hash space.
2. A shard counts each hash over all blocks and answers with one bit a hash: repeated or not.
3. Each block marks the words that repeated windows cover. Overlapping repeated windows merge
   into maximal intervals, which are cut out.

A window's identity has 112 bits, 48 (the sorted key) and 64 (sent beside it), of two polynomials
modulo 2**61 - 1 over two independent hashes of its words. The blocks' exchange is used by
steps 1 and 3, so texts are shuffled once, compressed.

Defined results: null text has no words; a text with fewer words than a window loses nothing;
repeated rows repeat each other's windows; a window that overlaps its own copy counts as
repeated; a very long text is a block of its own; ties do not arise; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import blobs
from quirelake.llm.words import SPACED, mix, polynomials, slices

WINDOW = 35
_SENT = "shard int, block long, mark long, keys binary, more binary, twice binary"
_BITS = "block long, shard int, mark long, bits binary"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:long,end:long>>"
_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KEYS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("mark", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("twice", pa.binary())])


def _order(key: np.ndarray, two: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The order by (key, two), and which of the ordered are equal to the one before. runs: key is made of sorted runs."""
    order = np.argsort(key, kind="stable" if runs else None)
    same = key[order[1:]] == key[order[:-1]]
    both = same & (two[order[1:]] == two[order[:-1]])
    if (same != both).any():  # two windows with one key: very rare
        order = np.lexsort((two, key))
        both = (key[order[1:]] == key[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return order, both


def _distinct(table: pa.Table, window: int):
    """Sorted distinct (key, second) of a block, how often each occurs, and where each window went."""
    parts, keys, more, times = [], [], [], []
    often = blobs.copies(table)
    for s in slices(table.column("text"), SPACED, lower=False):
        first = s.starts_of(window)
        if len(first):
            keys.append(mix(polynomials(s.hashes(), window, 1)[first]) >> np.uint64(64 - blobs.KEY_BITS))
            more.append(mix(polynomials(s.hashes(1), window, 2)[first]))
            times.append(often[s.first + s.doc_of()[first]])
        parts.append((s, first, len(first)))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    two = np.concatenate(more) if more else np.zeros(0, np.uint64)
    n = np.concatenate(times) if times else np.zeros(0, np.int64)
    order, same = _order(key, two)
    new = np.append(True, ~same)[: len(key)]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return parts, place, key[order[at]], two[order[at]], np.add.reduceat(n[order], at) if len(at) else n


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """One row per document: n_words, n_removed, the digest of what is kept, and the removed word intervals."""
    total = blobs.text_bytes(docs, text_col)
    n = blocks or blobs.plan(total)
    size = max(1, -(-total // n)) if blocks else blobs.block_size(total)
    rows = blobs.blocked(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], size, n)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, _, keys, two, count = _distinct(blobs.opened(table), window)
        me, mark = key[0].as_py(), blobs.mark(keys)
        out = [(i, me, mark, blobs.encode(keys[a:b]), two[a:b].tobytes(), np.packbits(count[a:b] > 1).tobytes()) for i, a, b in blobs.spans(keys, n)]
        return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), _KEYS, strict=True)] if out else [pa.array([], t.type) for t in _KEYS], schema=_KEYS)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        keys = [blobs.decode(x) for x in table.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        two = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("more").to_pylist()])
        # a hash held twice in one block only is marked there; elsewhere it has company anyway
        hit = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table.column("twice").to_pylist(), sizes.tolist(), strict=True)]).astype(bool)
        order, same = _order(np.concatenate(keys), two, runs=True)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        bits = [np.packbits(hit[e - k : e]).tobytes() for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "mark": table.column("mark"), "bits": pa.array(bits, pa.binary())})

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = blobs.opened(left)
        parts, place, keys, _, _ = _distinct(table, window)
        blobs.same_block(keys, right)
        at = blobs.cuts(keys, n)
        hit = np.zeros(len(keys), bool)
        for shard, bits in zip(right.column("shard").to_pylist(), right.column("bits").to_pylist(), strict=True):
            a, b = at[shard], at[shard + 1]
            hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a))
        hit = hit[place]
        words, removed, digests, intervals, seen = [], [], [], [], 0
        for s, first, k in parts:
            mine = first[hit[seen : seen + k]]
            seen += k
            edge = np.zeros(len(s.starts) + 1, np.int64)
            np.add.at(edge, mine, 1)
            np.add.at(edge, mine + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            data = s.data.tobytes()
            for i in range(s.n):
                a, b = int(s.words[i]), int(s.words[i + 1])
                lost = gone[a:b]
                words.append(b - a)
                removed.append(int(lost.sum()))
                if removed[-1]:
                    keep = np.flatnonzero(~lost) + a
                    text = b" ".join([data[x:y] for x, y in zip(s.starts[keep].tolist(), s.ends[keep].tolist(), strict=True)])
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
                    intervals.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
                else:
                    text = b" ".join(data[int(s.bounds[i]) : int(s.bounds[i + 1])].split())
                    intervals.append([])
                digests.append(hashlib.sha256(text).hexdigest())
        return blobs.repeated(pa.table({
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "intervals": pa.array(intervals, _INTERVALS),
        }), table)

    bits = rows.groupBy("block").applyInArrow(send, _SENT).groupBy("shard").applyInArrow(count, _BITS)
    return rows.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(cut, SCHEMA)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT rid, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35
), h AS (
  SELECT rid, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM p
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1
), lost AS (
  SELECT rid, list(DISTINCT j) AS js FROM (SELECT rid, unnest(generate_series(i, i + 34)) AS j FROM rep) GROUP BY rid
), k AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(js), 0) AS n_removed,
    CASE WHEN js IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(js, i)) END AS kept
  FROM d LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
