"""Layout: spatial anti-joins, reading order, headings, margins. Every join keeps (content, page) as equi keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as T

PAGE = ["content_id", "page_number"]


def block_not_in_table(blocks: DataFrame, tables: DataFrame, share: float = 0.5, floor: float = 0.0) -> DataFrame:
    """Blocks of which no table of the page covers ``share`` of their own area."""
    t = tables.select(*PAGE, F.col("bbox").alias("t_bbox"))
    cond = [blocks[k] == t[k] for k in PAGE] + [G.coverage(blocks["bbox"], t["t_bbox"], floor) >= share]
    return blocks.join(t, cond, "left_anti")


def iou_duplicates(items: DataFrame, least: float = 0.8) -> DataFrame:
    """(page, text, n): items that overlap an earlier one of equal text almost wholly."""
    rows = items.withColumn("norm", F.trim(F.regexp_replace("text", r"\s+", " "))).where((F.col("norm") != "") & (G.area(F.col("bbox")) > 0))
    old = rows.select(*(F.col(k).alias(f"o_{k}") for k in PAGE), F.col("norm").alias("o_norm"), F.col("ord").alias("o_ord"), F.col("bbox").alias("o_bbox"))
    cond = (rows["content_id"] == old["o_content_id"]) & (rows["page_number"] == old["o_page_number"]) & (rows["norm"] == old["o_norm"]) & (old["o_ord"] < rows["ord"]) & (G.iou(rows["bbox"], old["o_bbox"]) >= least)
    return rows.join(old, cond, "left_semi").groupBy(*PAGE, F.col("norm").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def margin_repeat(blocks: DataFrame) -> DataFrame:
    """Blocks in the top or bottom 5 % whose text a neighbouring page's margin has too go."""
    edge = (F.col("bbox.bottom") <= 0.05) | (F.col("bbox.top") >= 0.95)
    rows = blocks.withColumn("compact", T.compact_text(F.col("text"))).withColumn("edge", edge)
    near = rows.where(F.col("edge") & (F.col("compact") != "")).select("content_id", F.explode(F.array(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number"), "compact", F.lit(True).alias("edge")).distinct()
    return rows.join(near, [*PAGE, "compact", "edge"], "left_anti").drop("compact", "edge")


def heading_flag(blocks: DataFrame) -> DataFrame:
    """Adds heading: bold, or 1.28 times the page's median size; none where no size is known."""
    median = F.median(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy(*PAGE))
    return blocks.withColumn("median_size", median).withColumn("heading", F.coalesce((F.col("median_size") > 0) & (F.col("bold") | (F.col("size") >= 1.28 * F.col("median_size"))), F.lit(False)))


def native_markdown(blocks: DataFrame) -> DataFrame:
    """Pages written from their native blocks in reading order: bold or large ones of up to eighty letters are headings."""
    rows = heading_flag(reading_order(blocks)).withColumn("t", T.strip(F.col("text"))).where("t <> ''")
    short = F.char_length(T.compact_text(F.col("t"))) <= 80
    text = F.when(F.col("heading") & short, F.concat(F.lit("## "), F.col("t"))).otherwise(F.col("t"))
    listed = F.array_sort(F.collect_list(F.struct("reading_order", text.alias("t"))))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("markdown"))


def region_markdown(regions: DataFrame) -> DataFrame:
    """Pages written from layout regions (…, ord, label, native_label, content, rendered): titles get their marks, pictures a
    placeholder, tables what was rendered of them, else their content."""
    c, label, native = T.strip(F.coalesce("content", F.lit(""))), F.coalesce("label", F.lit("")), F.coalesce("native_label", F.lit(""))
    some = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), "\n\n")
    titled = lambda mark: F.when(c.startswith("#"), c).otherwise(F.concat(F.lit(mark), c))
    text = (
        F.when((label == "table") | (native == "table"), F.coalesce("rendered", c))
        .when((label == "image") | native.isin("chart", "image", "footer_image", "header_image"), some(F.lit("<!-- image -->"), c))
        .when(c == "", "").when(native == "doc_title", titled("# ")).when(native == "paragraph_title", titled("## ")).otherwise(c)
    )
    listed = F.filter(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"] != "")
    return regions.groupBy(*PAGE).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("markdown"))


def region_order(regions: DataFrame) -> DataFrame:
    """Final reading order 1..n by top, left and given order; regions without a box come last."""
    key = [F.coalesce("bbox.top", F.lit(2.0)), F.coalesce("bbox.left", F.lit(2.0)), F.col("ord")]
    return regions.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*key)))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds reading_order: rows by (top, left), unless the page clearly has two columns.

    Two columns: at least four blocks no wider than 0.68 of the page, the widest gap between
    neighbouring centres at least 0.18 of it with two blocks on each side, and every wider block
    wholly above or below them."""
    page = Window.partitionBy(*PAGE)
    rows = blocks.withColumn("narrow", F.col("bbox.right") - F.col("bbox.left") <= 0.68 * F.col("page_width"))
    rows = rows.withColumn("center", (F.col("bbox.left") + F.col("bbox.right")) / 2)
    # among narrow blocks only: place by centre and the gap to the next
    by = Window.partitionBy(*PAGE, "narrow").orderBy("center", "bbox.top", "bbox.left", "ord")
    rows = rows.withColumn("i", F.row_number().over(by)).withColumn("gap", F.lead("center").over(by) - F.col("center"))
    own = F.when(F.col("narrow"), F.struct("gap", "i"))
    rows = rows.withColumn("best", F.max(F.when(F.col("gap").isNotNull(), own)).over(page)).withColumn("n", F.count(F.when(F.col("narrow"), 1)).over(page))
    rows = rows.withColumn("top", F.min(F.when(F.col("narrow"), F.col("bbox.top"))).over(page)).withColumn("bottom", F.max(F.when(F.col("narrow"), F.col("bbox.bottom"))).over(page))
    zone = F.when(F.col("narrow"), F.when(F.col("i") <= F.col("best.i"), 1).otherwise(2)).when(F.col("bbox.bottom") <= F.col("top"), 0).when(F.col("bbox.top") >= F.col("bottom"), 3)
    rows = rows.withColumn("zone", zone)
    clear = (F.col("page_width") > 0) & (F.col("n") >= 4) & (F.col("best.gap") >= 0.18 * F.col("page_width")) & (F.col("best.i") >= 2) & (F.col("n") - F.col("best.i") >= 2) & (F.count(F.when(F.col("zone").isNull(), 1)).over(page) == 0)
    rows = rows.withColumn("z", F.when(F.coalesce(clear, F.lit(False)), F.col("zone")).otherwise(0))
    out = rows.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("z", "bbox.top", "bbox.left", "ord")))
    return out.select(*blocks.columns, "reading_order")


def order_inversion(anchors: DataFrame, pages: DataFrame, least: int = 4) -> DataFrame:
    """Pages on which unique anchor lines (ord, text) stand in another order than in the page's content. A page's anchors are
    gathered and meet its content once."""
    a = anchors.select(*PAGE, F.col("ord").cast("long").alias("ord"), T.compact_text(F.col("text")).alias("a")).where(F.char_length("a") >= 8)
    once = a.groupBy(*PAGE, "a").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).where("n = 1")
    listed = once.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "a"))).alias("anchors"))
    met = listed.join(pages.select(*PAGE, T.compact_text(F.col("content")).alias("body")), PAGE)
    # where an anchor stands, if it does so once; then one walk, in which no expression is worked out again for each anchor
    places = "filter(transform(anchors, x -> if(instr(body, x.a) > 0 AND locate(x.a, body, instr(body, x.a) + char_length(x.a)) = 0, instr(body, x.a), 0)), p -> p > 0)"
    start, step = "named_struct('n', 0, 'last', 0, 'back', false)", "(s, p) -> named_struct('n', s.n + 1, 'last', p, 'back', s.back OR p < s.last)"
    walked = met.select(*PAGE, F.expr(f"aggregate({places}, {start}, {step})").alias("w"))
    return walked.where("w.n > 0").select(*PAGE, ((F.col("w.n") >= least) & F.col("w.back")).alias("inverted"))
