"""Exact dedup: skew-safe combining of equal texts.

Three combining stages, each of which groups by the full normalised text beside its digest, so
equal digests of different texts never merge:

1. local: map-side partial aggregation inside each input partition;
2. salted: what is left is merged by digest, text and a salt, the input partition's number modulo
   ``salts``: a text that fills a third of the table is spread over so many tasks;
3. global: the winners of all salts are combined, again by full content.

Documents then find their group by an equi-join of narrow rows on the digest (no text in it);
adaptive skew-join splitting covers a hot digest there. Should a digest belong to several texts, which
stage 3 counts, the rows of such digests are joined by their text instead.

Defined results: null text is an empty text; null ids rank after all others; rows repeated with
the same id and length count as members, and exactly one of them is kept; ties in length go to the
smallest id; a very long text is compared whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.graph import saved

#: ASCII white space, which does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
_MAX = "9223372036854775807"
_WIDE = "100000000000000000000"  # 10**20
_PIECE = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))  # never null, so that no join asks for it again


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"),
    ).withColumn("digest", digest(F.col("norm")))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, rank, n) of each text, dealt by digest."""
    # longest original first, then smallest id: one number, so that hash aggregation can hold it
    rank = F.expr(
        f"cast(len as decimal(10,0)) * cast({_WIDE} as decimal(21,0))"
        f" + coalesce(cast({_MAX} as decimal(20,0)) - cast(doc_id as decimal(20,0)) + 1, 0)"
    ).cast("decimal(38,0)")
    local = rows.select("digest", "norm", rank.alias("rank"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = local.groupBy("digest", "norm", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    return salted.repartition("digest").groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))


def _winner(rank: str = "rank") -> list[Column]:
    tail = f"cast({rank} % {_WIDE} as decimal(20,0))"
    return [F.expr(f"cast(floor({rank} / {_WIDE}) as int)").alias("w_len"), F.expr(f"if({tail} = 0, null, cast({_MAX} - ({tail} - 1) as bigint))").alias("keep_id")]


def _placed(members: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Each member beside its group; of rows that are repeated the first is the best one."""
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("w_len"))
    joined = members.join(winners, keys).select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), best.alias("best"), "digest", "copies")
    # repeated rows come back in pieces, so that no array grows with them
    pieces = joined.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_PIECE})")))
    every = pieces.withColumn("copy", F.explode(F.expr(f"sequence(piece * {_PIECE}, least(copies, (piece + 1) * {_PIECE}) - 1)")))
    return every.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, id_col, text_col, digest)
    # of a digest with one text, that text's numbers; winners are saved, so that both sides of the join are plain exchanges, and a hot digest can be split
    winners = _groups(rows, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("rank").alias("rank"), F.max("n").alias("n"))
    winners = saved(winners.select("digest", "texts", "n", *_winner()))
    members = rows.groupBy("doc_id", "digest", "len").agg(F.count(F.lit(1)).alias("copies"))
    out = _placed(members, winners.where("texts = 1").drop("texts"), ["digest"])
    shared = winners.where("texts > 1").select("digest")
    if not shared.take(1):
        return out
    some = rows.join(shared, "digest", "left_semi")
    members = some.groupBy("doc_id", "digest", "norm", "len").agg(F.count(F.lit(1)).alias("copies"))
    return out.union(_placed(members, _groups(some, salts).select("digest", "norm", "n", *_winner()), ["digest", "norm"]))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns. Of rows with one id, one normalised text and one
    length, which are repeated ones and those with white space of other kinds, the one with the smallest text stays."""
    winners = _groups(_rows(docs, id_col, text_col, digest), salts).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("rank").alias("rank"))
    winners = saved(winners.select("digest", "texts", *_winner()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # an id as text, as null ids are compared too
    key = {"k_id": F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), "k_len": F.char_length(text)}
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest(normalised(text)).alias("digest"), *(v.alias(k) for k, v in key.items()))

    def kept(rows: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
        best = winners.select(*keys, F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("k_id"), F.col("w_len").alias("k_len"))
        # the join deals by all keys, so that the aggregation needs no exchange of its own
        met = rows.join(best, [*keys, "k_id", "k_len"])
        return met.groupBy(*keys, "k_id", "k_len").agg(F.min_by("row", F.coalesce(F.col("row")[text_col], F.lit(""))).alias("row")).select("row.*")

    out = kept(rows, winners.where("texts = 1"), ["digest"])
    shared = winners.where("texts > 1").select("digest")
    if not shared.take(1):
        return out
    some = _groups(_rows(docs, id_col, text_col, digest).join(shared, "digest", "left_semi"), salts).select("digest", "norm", *_winner())
    rows = rows.join(shared, "digest", "left_semi").withColumn("norm", normalised(F.col("row")[text_col]))
    return out.union(kept(rows, some, ["digest", "norm"]))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
    row_number() OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
