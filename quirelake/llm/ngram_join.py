"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and the classes it links.

1. Shingles of each block of documents are counted over the corpus by exchanging sorted hashes
   (see blobs). In the order (document frequency, hash), two sets that reach the threshold share
   a shingle in their prefixes; shingles of one document only sort first and match nothing, so
   most documents have no prefix left and drop out here.
2. Equal sets become one. Sets with the same size and the same prefix form one group.
3. First pass: each group pairs with one pivot among the groups that share a prefix shingle (the
   one with the fewest unshared shingles), and with its own representative. Pairs are expanded to
   members and verified; links give preliminary classes.
4. Second pass: all pairs of groups that share a prefix shingle and are in different preliminary
   classes, if they pass the length and positional filters (the smaller side needs its index
   prefix only). Pairs are expanded to members and verified.

Pairs inside a class need no check, as classes are what is asked for; no other pair is left out.
Sets are identified by two 64-bit sums, each of mixed shingle hashes from word hashes of its own;
an intersection counts equal 64-bit hashes.

Defined results: null and empty texts have no shingles and are a class of their own; a text with
fewer words than a shingle is one shingle of all its words; repeated rows are members like
others; ties of prefix order go by hash and do not change the classes; a class whose ids are all
null has a null id; a very long text is a block of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import blobs
from quirelake.llm.graph import components, saved
from quirelake.llm.words import SPACED, mix, slices

SHINGLE, PERCENT = 5, 75
_SETS = "doc_id long, n long, one long, two long, alone long, prefix array<long>, shared binary"
_U = np.uint64


def _levels(count: np.ndarray) -> np.ndarray:
    """Document frequencies in a byte: exact to 127, then eight steps an octave."""
    return np.where(count < 128, count, np.minimum(128 + (8 * np.log2(np.maximum(count, 128) / 128)).astype(np.int64), 254))


def _shingles(table: pa.Table, size: int, seconds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash if asked for) of the distinct shingles of each text, by row and hash."""
    rows, hashes, others = [], [], []
    for s in slices(table.column("text"), SPACED):
        first, g = s.grams(size, s.hashes(), short=True)
        row = s.doc_of()[first]
        order = np.argsort(g)
        # rows of a slice are few, mostly: 16-bit numbers sort by radix
        order = order[np.argsort(row[order].astype(np.uint16 if s.n < 1 << 16 else np.int64), kind="stable")]
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        rows.append(row[new] + s.first)
        hashes.append(g[new])
        if seconds:
            others.append(s.grams(size, s.hashes(1), short=True)[1][order[new]])
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(others) if seconds else np.zeros(0, np.uint64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, blocks: int | None = None) -> DataFrame:
    """One row per document (see _SETS): set size, identity, and where a partner is possible the shared
    shingles and those of the prefix, in order."""
    total = blobs.text_bytes(docs, text_col)
    n = blocks or blobs.plan(total)
    block_bytes = max(1, -(-total // n)) if blocks else blobs.block_size(total)
    # a wrong match of a counting key only makes a shingle look shared; four bits over the number of words keep that rare
    bits = blobs.key_bits(total, 4)
    shift = _U(64 - bits)
    rows = blobs.blocked(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], block_bytes, n)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        keys, count = np.unique(_shingles(blobs.opened(table), size)[1] >> shift, return_counts=True)
        spans, mark = blobs.spans(keys, n, bits), blobs.mark(keys)
        return pa.table({
            "shard": pa.array([x[0] for x in spans], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(spans), pa.int64()),
            "mark": pa.array([mark] * len(spans), pa.int64()),
            "keys": pa.array([blobs.encode(keys[a:b]) for _, a, b in spans], pa.binary()),
            "counts": pa.array([blobs.pack(count[a:b]) for _, a, b in spans], pa.binary()),
        })

    def count(key: tuple, table: pa.Table) -> pa.Table:
        keys = [blobs.decode(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([blobs.unpack(x) for x in table.column("counts").to_pylist()])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        sums = np.add.reduceat(counts[order], at)
        level = np.empty(len(every), np.uint8)
        level[order] = np.repeat(_levels(sums), np.diff(np.append(at, len(every))))
        ends = np.cumsum([len(k) for k in keys])
        levels = [blobs.pack(level[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "mark": table.column("mark"), "levels": pa.array(levels, pa.binary())})

    def describe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = blobs.opened(left)
        row, h, h2 = _shingles(table, size, seconds=True)
        k, _, place = blobs.distinct(h >> shift)
        blobs.same_block(k, right)
        right = right.sort_by("shard")
        level = np.concatenate([np.zeros(0, np.int64), *(blobs.unpack(x) for x in right.column("levels").to_pylist())])[place]
        edge = np.searchsorted(row, np.arange(table.num_rows + 1))
        one = np.concatenate(([_U(0)], np.cumsum(mix(h + _U(0x8EBC6AF09C88C6E3)))))
        two = np.concatenate(([_U(0)], np.cumsum(mix(h2 ^ _U(0x589965CC75374CC3)))))
        ids = [(x[edge[1:]] - x[edge[:-1]]).view(np.int64).tolist() for x in (one, two)]
        out = []
        for a, b, sid, sid2 in zip(edge[:-1].tolist(), edge[1:].tolist(), *ids, strict=True):
            m = b - a
            alone = int((level[a:b] < 2).sum())
            probe = m - -(-percent * m // 100) + 1 - alone
            if m and probe > 0 and alone < m:
                some = np.flatnonzero(level[a:b] > 1) + a
                first = some[np.lexsort((h[some], level[some]))][:probe]
                out.append((m, sid, sid2, alone, h[first].view(np.int64), h[some].tobytes()))
            else:
                out.append((m, None, None, alone, None, None))
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = ["n", "one", "two", "alone", "prefix", "shared"]
        return blobs.repeated(pa.table({"doc_id": table.column("doc_id"), **{x: pa.array(list(c), t) for x, c, t in zip(names, cols, types, strict=True)}}), table)

    sent = rows.groupBy("block").applyInArrow(send, "shard int, block long, mark long, keys binary, counts binary")
    counted = sent.groupBy("shard").applyInArrow(count, "block long, shard int, mark long, levels binary")
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(describe, _SETS)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that reach the threshold."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for n_a, n_b, a, b in zip(*(x.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                same = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append(100 * same >= percent * (n_a + n_b - same))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sid, class) of the sets that are linked with another, from distinct sets (sid, n, alone, prefix, shared)."""
    key = F.xxhash64("n", "alone", "prefix")
    groups = sets.groupBy(key.alias("g_key"), "n", "alone").agg(F.min("sid").alias("g"))
    member = saved(sets.select("sid", "n", "alone", key.alias("g_key")).join(groups, ["g_key", "n", "alone"]).select("sid", "g", "n"))
    head = sets.join(member.where("sid = g").select("sid"), "sid", "left_semi")
    posts = saved(head.select(F.col("sid").alias("g"), "n", F.size("prefix").alias("eff"), "alone", F.posexplode("prefix").alias("i", "token")).selectExpr("token", "g", "n", "eff", "alone + i as pos"))

    # first pass: one pivot each
    near = "100 * least(n, p.n) >= {0} * greatest(n, p.n)".format(percent)
    best = posts.groupBy("token").agg(F.max(F.struct("eff", "n", "g")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    pivot = posts.join(best, "token").where(f"g <> p.g and {near}").groupBy("g").agg(F.max("p").alias("p")).select("g", F.col("p.g").alias("a"))
    stars = member.join(pivot, "g").select("a", F.col("sid").alias("b")).union(member.where("sid <> g").select(F.col("g").alias("a"), F.col("sid").alias("b"))).distinct()
    found = saved(_verify(stars, sets, percent))
    first = components(found)

    # second pass: pairs across the classes so far
    classed = member.join(first.select(F.col("id").alias("sid"), F.col("component").alias("c")), "sid", "left").select("sid", "g", "n", F.coalesce("c", "sid").alias("c"))
    classed = saved(classed)
    mixed = posts.join(classed.select("g", "c").distinct(), "g")
    several = mixed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    open_ = saved(mixed.join(several, "token", "left_semi"))
    x = open_.where(f"pos < n - ceil({2 * percent} * n / {100 + percent}) + 1").selectExpr("token", "g gx", "n nx", "c cx", "pos px")
    y = open_.selectExpr("token", "g gy", "n ny", "c cy", "pos py")
    # for equal sizes either side may hold the index prefix, so that both orders pass; a pair is named in one
    passes = f"cx <> cy and nx <= ny and 100 * nx >= {percent} * ny and least(nx - px, ny - py) * {100 + percent} >= {percent} * (nx + ny)"
    swap = "nx = ny and (gx > gy or gx = gy and cx > cy)"
    named = [f"if({swap}, {a}{p}, {a}{q}) {a}{q}" for p, q in (("y", "x"), ("x", "y")) for a in "gc"]
    pairs = x.join(y, "token").where(passes).selectExpr(*named).distinct()
    of = lambda s, k: classed.selectExpr(f"g g{k}", f"c c{k}", f"sid {s}")
    wide = pairs.join(of("a", "x"), ["gx", "cx"]).join(of("b", "y"), ["gy", "cy"]).select("a", "b")
    more = saved(_verify(wide, sets, percent))
    return components(found.union(more))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    every = saved(shingle_sets(docs, id_col, text_col, size, percent, blocks))
    same = ["one", "two", "n"]
    # numbered once and saved, so that all that follows can name a set by one number
    sets = every.where("shared is not null").groupBy(*same).agg(*(F.first(c).alias(c) for c in ("alone", "prefix", "shared")))
    sets = saved(sets.withColumn("sid", F.monotonically_increasing_id()))
    linked = links(sets.select("sid", "n", "alone", "prefix", "shared"), percent)
    # saved, so that both sides of the joins are plain exchanges, of which a hot set or class can be split
    named = saved(sets.select(*same, "sid").join(linked.select(F.col("id").alias("sid"), "component"), "sid", "left").select(*same, F.coalesce("component", "sid").alias("c")))
    # texts that can have no partner are in no set, and take no part in the joins
    alone = every.where("one is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = every.where("one is not null").select("doc_id", *same).join(named, same).select("doc_id", "n", "c")
    least = saved(rows.groupBy("c").agg(F.min("doc_id").alias("low")))
    return alone.union(rows.join(least, "c").select("doc_id", "n", "low"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), common AS (
  SELECT g FROM e GROUP BY g HAVING count(*) > 1
), f AS (
  SELECT * FROM e SEMI JOIN common USING (g)
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT x AS start, x AS node FROM link
  UNION
  SELECT r.start, l.y FROM reach r JOIN link l ON r.node = l.x
), low AS (
  SELECT start, min(node) AS c FROM reach GROUP BY start
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN low ON doc_id = start
"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The documents, with all their columns, whose id is that of their class. Rows without an id stay.

    Ids that go are broadcast if they are counted to be at most ``broadcast_rows`` (16 bytes each), else joined by a shuffle."""
    classes = jaccard_classes(docs, id_col, text_col, size, percent)
    gone = saved(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
