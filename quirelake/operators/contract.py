"""The public form of a parsed content: units with regions in reading order, blocks, tables, status and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import layout

VERSION = "content-parse-result/1.0"
_COLUMNS = ["region_id", "kind", "bbox", "text", "ord"]


def regions(pages: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(content_id, page_number, region_id, kind, reading_order, text) of all regions.

    Native blocks are numbered in reading order before those inside tables go, so numbers have gaps; pages without blocks have one
    region of their plain text; then come tables. The final order is by place, regions without one last."""
    page = layout.PAGE
    numbered = layout.heading_flag(layout.reading_order(blocks)).withColumn("i", F.col("reading_order").cast("string"))
    name = lambda *xs: F.concat(F.lit("p"), F.col("page_number").cast("string"), *xs)
    kept = layout.block_not_in_table(numbered, tables)
    own = kept.select(*page, name(F.lit("-r"), F.col("i")).alias("region_id"), F.when(F.col("heading"), "heading").otherwise("text").alias("kind"), "bbox", "text", F.col("reading_order").cast("long").alias("ord"))
    plain = pages.join(blocks.select(*page).distinct(), page, "left_anti").withColumn("t", T.strip(T.plain_lines(F.coalesce("content", F.lit(""))))).where("t <> ''")
    alone = plain.select(*page, name(F.lit("-r1")).alias("region_id"), F.lit("text").alias("kind"), F.lit(None).cast(dict(blocks.dtypes)["bbox"]).alias("bbox"), F.col("t").alias("text"), F.lit(1).cast("long").alias("ord"))
    # tables follow all blocks of a page, whatever their numbers
    grids = tables.select(*page, F.concat("table_id", F.lit("-region")).alias("region_id"), F.lit("table").alias("kind"), "bbox", F.lit(None).cast("string").alias("text"), (F.lit(1 << 30) + F.col("ordinal")).cast("long").alias("ord"))
    every = own.unionByName(alone).unionByName(grids).withColumn("region_ord", F.col("ord"))
    return layout.region_order(every).select(*page, "region_id", "kind", F.col("reading_order").cast("long").alias("reading_order"), "bbox", "text")


def units(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row a page: its regions in order, and which are blocks and tables."""
    page = layout.PAGE
    listed = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "kind", "text")))
    got = found.groupBy(*page).agg(listed.alias("regions"))
    none = F.array().cast(dict(got.dtypes)["regions"])
    rows = pages.join(got, page, "left").withColumn("regions", F.coalesce("regions", none))
    ids = lambda is_table: F.transform(F.filter("regions", lambda r: (r["kind"] == "table") == F.lit(is_table)), lambda r: r["region_id"])
    return rows.select(
        "content_id", F.col("page_number").alias("index"), F.concat(F.lit("p"), F.col("page_number").cast("string")).alias("unit_id"), "status", "regions",
        F.transform(ids(False), lambda r: F.replace(r, F.lit("-r"), F.lit("-b"))).alias("block_ids"), F.transform(ids(True), lambda r: F.regexp_replace(r, "-region$", "")).alias("table_ids"),
    )


def contents(unit_rows: DataFrame) -> DataFrame:
    """One row a content: its units in order, and partial if any of them failed."""
    members = [c for c in unit_rows.columns if c != "content_id"]
    listed = F.array_sort(F.collect_list(F.struct(*members)))
    got = unit_rows.groupBy("content_id").agg(listed.alias("units"), F.count_if(F.col("status") == "failed").alias("failed_units"))
    return got.select(F.lit(VERSION).alias("schema_version"), "content_id", F.when(F.col("failed_units") > 0, "partial").otherwise("completed").alias("status"), "units", "failed_units")


def logical_tables(fragments: DataFrame) -> DataFrame:
    """Logical tables with their fragments in order, and the units they come from."""
    rows = fragments.where("logical_table_id is not null")
    listed = F.array_sort(F.collect_list(F.struct("page_number", "ordinal", "fragment_id")))
    got = rows.groupBy("content_id", "logical_table_id").agg(F.transform(listed, lambda x: x["fragment_id"]).alias("fragment_ids"), F.array_sort(F.collect_set("page_number")).alias("source_units"))
    return got


def table_ordinals(tables: DataFrame, order: list[str]) -> DataFrame:
    """Tables of a page, numbered, with their names."""
    ordinal = F.row_number().over(Window.partitionBy(*layout.PAGE).orderBy(*order))
    return tables.withColumn("ordinal", ordinal).withColumn("table_id", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_t"), F.col("ordinal").cast("string")))
