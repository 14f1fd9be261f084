"""Fusion: one value of each cell from several sources, kept as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

# Names of the sources, in the order of insertion and of preference.
FIRST = ("qwen", "glm", "docling")
FINAL = ("glm", "docling", "qwen")


def _rank(source: Column, order: tuple) -> Column:
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(source == s, i).otherwise(out)
    return out


def field_consensus(cells: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, source, value): final value, consistent, conflict, qwen_only.

    A normalised value of at least two sources wins; its text is that of the best of FINAL. Otherwise the
    first non-empty value in the order FIRST counts."""
    rows = cells.where(F.col("source").isin(*FIRST)).withColumn("norm", T.normalized(F.col("value")))
    votes = rows.groupBy(*keys, "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min(_rank(F.col("source"), FIRST)).alias("first"),
        F.min_by("value", _rank(F.col("source"), FINAL)).alias("text"),
        F.min(F.when(F.col("value") != "", F.struct(_rank(F.col("source"), FIRST).alias("i"), F.col("value").alias("v")))).alias("raw"),
        F.bool_and(F.col("source") == "qwen").alias("own"),
    )
    real = F.col("norm") != ""
    got = votes.groupBy(*keys).agg(
        F.min(F.when(real & (F.col("n") >= 2), F.struct("first", "text"))).alias("agreed"), F.min("raw").alias("raw"),
        F.count_if(real).alias("kinds"), F.bool_and(F.when(real, F.col("own"))).alias("own"),
    )
    agreed = F.col("agreed").isNotNull()
    return got.select(
        *keys,
        F.when(agreed, F.col("agreed.text")).otherwise(F.coalesce("raw.v", F.lit(""))).alias("final"),
        agreed.alias("consistent"),
        (~agreed & (F.col("kinds") > 1)).alias("conflict"),
        (~agreed & F.coalesce("own", F.lit(False))).alias("qwen_only"),
    )


def metadata_vote(values: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, field, idx, value, statement): the value most bands agree on; for the company, ties go to the one
    that most statement titles contain; then to the earliest."""
    rows = values.withColumn("value", F.trim("value")).where("value <> ''").withColumn("norm", T.normalized(F.col("value")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "field", "norm")))
    titles = values.where("field = 'statement_title'").groupBy(*keys).agg(F.collect_list(T.normalized(F.col("value"))).alias("titles"))
    rows = rows.join(titles, keys, "left")
    hits = F.when(F.col("field") == "company_name", F.size(F.filter(F.coalesce("titles", F.array().cast("array<string>")), lambda t: (t != "") & t.contains(F.col("norm"))))).otherwise(0)
    return rows.withColumn("hits", hits).groupBy(*keys, "field").agg(F.max_by("value", F.struct("n", "hits", -F.col("idx"))).alias("value"))


def evidence_strength(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: cells on which two sources agree, and values present."""
    rows = cells.where(F.col("source").isin(*FIRST)).withColumn("norm", T.normalized(F.col("value"))).where("norm <> ''")
    n = rows.groupBy(*keys, "col", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "col").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return n.groupBy(*keys).agg(F.count_if(F.col("most") >= 2).alias("agreements"), F.sum("all").alias("coverage"))


def conflict_topk(conflicts: DataFrame, keys: list[str], k: int = 24) -> DataFrame:
    """The first conflicts of each page: those about dates first, then by id as text."""
    order = [F.col("has_date").desc(), F.col("conflict_id")]
    return conflicts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def conflict_apply(conflicts: DataFrame, answers: DataFrame, keys: list[str], k: int = 24) -> DataFrame:
    """Answers for the first conflicts replace the final value; a null answer leaves it unresolved."""
    top = conflict_topk(conflicts, keys, k).select(*keys, "conflict_id")
    use = answers.join(top, [*keys, "conflict_id"], "left_semi").select(*keys, "conflict_id", "observed")
    rows = conflicts.join(use, [*keys, "conflict_id"], "left")
    return rows.select(*keys, "conflict_id", F.coalesce("observed", "final").alias("final"), F.col("observed").isNotNull().alias("resolved"))


#: Codes that a page has dealt with once it is adopted (fixed values).
RESOLVED = ["low_text_content", "repeated_text", "table_header_propagation", "table_shape_explosion", "table_structure_invalid", "unanchored_table_numbers", "visual_text_mismatch"]


def page_overlay(pages: DataFrame, adopted: DataFrame, keys: list[str]) -> DataFrame:
    """Adopted pages replace those with their keys."""
    return pages.join(adopted.select(*keys), keys, "left_anti").unionByName(adopted)


def adopt(pages: DataFrame, fragments: DataFrame, warnings: DataFrame, new_pages: DataFrame, new_fragments: DataFrame, keys: list[str], resolved: list[str] = RESOLVED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, fragments and warnings after some pages were adopted: theirs replace what was there, and the warnings that adopting
    them resolves go."""
    there = new_pages.select(*keys).distinct()
    left = warnings.join(there.withColumn("__new", F.lit(True)), keys, "left").where(F.col("__new").isNull() | ~F.col("code").isin(*resolved)).drop("__new")
    return page_overlay(pages, new_pages, keys), fragments.join(there, keys, "left_anti").unionByName(new_fragments), left


def cell_quality(cells: DataFrame, keys: list[str]) -> DataFrame:
    """confirmed by two or more sources, else selected; conflicted or missing in an invalid fragment."""
    n = cells.groupBy(*keys).agg(F.count_distinct(F.when(T.normalized(F.col("value")) != "", F.col("source"))).alias("sources"), F.bool_and("valid").alias("valid"))
    quality = F.when(~F.col("valid") & (F.col("sources") == 0), "missing").when(~F.col("valid"), "conflicted").when(F.col("sources") >= 2, "confirmed").otherwise("selected")
    return n.withColumn("quality", quality)
