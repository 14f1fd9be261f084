"""Tables: fragments, cells, spans, links across pages, rendering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from quirelake.functions import text as T
from quirelake.functions.pyfuncs import seq_ratio


def column_boundaries(cells: DataFrame, keys: list[str], columns: str) -> DataFrame:
    """Per table and column, the mean of estimated left edges, else an even share; six places."""
    got = cells.groupBy(*keys, "column_index", columns).agg(F.avg("left_edge").alias("mean"))
    return got.select(*keys, "column_index", F.coalesce("mean", F.col("column_index") / F.col(columns)).alias("boundary"))


def fragment_ends(fragments: DataFrame) -> DataFrame:
    """Per page its last and its first fragment, by ordinal."""
    one = F.struct(*(c for c in fragments.columns if c not in ("content_id", "page_number")))
    return fragments.groupBy("content_id", "page_number").agg(F.max_by(one, "ordinal").alias("tail"), F.min_by(one, "ordinal").alias("head"))


def headers_alike(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether two header signatures are alike; equal ones need no comparison."""
    return F.when(a == b, F.lit(True)).otherwise(seq_ratio(a, b) >= least)


def cross_page_link(fragments: DataFrame) -> DataFrame:
    """(content_id, left_id, right_id): last table of a page with the first of the next.

    From (content_id, page_number, fragment_id, ordinal, valid, top, bottom, boundaries, header, has_header, n_rows). Both
    valid, left ends at 0.85 or lower, right begins at 0.15 or higher, as many columns with edges within 0.02
    on average. A right side with a header row needs a header alike; one without needs rows.
    A fragment links once: where single-table pages chain, every second pair counts, from the start of the chain."""
    ends = fragment_ends(fragments)
    left = ends.select("content_id", "page_number", F.col("tail").alias("l"))
    right = ends.select("content_id", (F.col("page_number") - 1).alias("page_number"), F.col("head").alias("r"), (F.col("head.ordinal") == F.col("tail.ordinal")).alias("single"))
    drift = F.aggregate(F.zip_with("l.boundaries", "r.boundaries", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size("l.boundaries"), F.lit(1))
    fits = (
        F.col("l.valid") & F.col("r.valid") & (F.col("l.bottom") >= 0.85) & (F.col("r.top") <= 0.15)
        & (F.size("l.boundaries") == F.size("r.boundaries")) & (drift <= 0.02)
    )
    named = F.col("r.has_header") & (F.coalesce("l.header", F.lit("")) != "") & (F.coalesce("r.header", F.lit("")) != "")
    pairs = left.join(right, ["content_id", "page_number"]).where(fits & (named | (~F.col("r.has_header") & (F.col("r.n_rows") > 0))))
    # only pairs that are left have their headers compared
    pairs = pairs.where(~F.col("r.has_header") | headers_alike(F.col("l.header"), F.col("r.header")))
    # a chain goes on where the pair before ends in the fragment that this one begins with
    w = Window.partitionBy("content_id").orderBy("page_number")
    on = (F.lag("page_number").over(w) == F.col("page_number") - 1) & F.lag("single").over(w)
    pairs = pairs.withColumn("start", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1))
    pairs = pairs.withColumn("chain", F.sum("start").over(w))
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("content_id", "chain").orderBy("page_number")))
    return pairs.where(F.col("place") % 2 == 1).select("content_id", F.col("l.fragment_id").alias("left_id"), F.col("r.fragment_id").alias("right_id"))


def cell_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors only: cells that the span of another anchor covers go. Row 0 is the header."""
    spans = cells.where((F.col("row_span") > 1) | (F.col("col_span") > 1))
    covered = spans.select(*keys, "r", "c", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1)).alias("rr"), "col_span")
    covered = covered.select(*keys, "r", "c", "rr", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("col_span") - 1)).alias("cc")).where("rr <> r or cc <> c")
    gone = covered.select(*keys, F.col("rr").alias("r"), F.col("cc").alias("c")).distinct()
    return cells.join(gone, [*keys, "r", "c"], "left_anti").withColumn("header", F.col("r") == 0)


def overlapping_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any two cells of a table claim one place."""
    places = cells.select(*keys, F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1)).alias("rr"), "c", "col_span")
    places = places.select(*keys, "rr", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("col_span") - 1)).alias("cc"))
    n = places.groupBy(*keys, "rr", "cc").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max("n").alias("n")).select(*keys, (F.col("n") > 1).alias("overlapping"))


def gfm_render(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown of each table from rows (row_index, cells); short rows are padded, row 0 is the header."""
    wide = F.max(F.size("cells")).over(Window.partitionBy(*keys))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    out = rows.withColumn("w", wide).withColumn("cells", F.concat(F.transform("cells", T.gfm_cell), F.array_repeat(F.lit(""), (F.col("w") - F.size("cells")).cast("int"))))
    rule = line(F.array_repeat(F.lit("---"), F.col("w").cast("int")))
    out = out.withColumn("t", F.when(F.col("row_index") == 0, F.concat(line(F.col("cells")), F.lit("\n"), rule)).otherwise(line(F.col("cells"))))
    listed = F.array_sort(F.collect_list(F.struct("row_index", "t")))
    return out.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("markdown"))


def table_shapes(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(rows below the header, columns) of each run of pipe lines; separator lines do not count."""
    pipe = F.trim(text).startswith("|")
    rows = lines.withColumn("pipe", pipe).withColumn("run", F.sum(F.when(pipe, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(order)))
    body = F.regexp_replace(F.trim(text), r"^\||\|$", "")
    rows = rows.where("pipe").withColumn("cols", F.size(F.split(body, r"\|"))).where(~body.rlike(r"^[ :|-]*-[ :|-]*$"))
    return rows.groupBy(*keys, "run").agg((F.count(F.lit(1)) - 1).alias("n_rows"), F.max("cols").alias("n_cols")).drop("run")


def merged_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of linked fragments one after the other, from pairs (left_id, right_id) and rows (fragment_id, row_index,
    cells, has_header); a header row of the right side goes if it is alike the left one's."""
    sign = F.concat_ws("|", F.transform("cells", lambda c: T.fold(F.regexp_replace(c, T.WS, ""))))
    head = rows.where("row_index = 0").select("fragment_id", sign.alias("h"), "has_header")
    both = pairs.join(head.select(F.col("fragment_id").alias("left_id"), F.col("h").alias("a")), "left_id").join(head.select(F.col("fragment_id").alias("right_id"), F.col("h").alias("b"), "has_header"), "right_id", "left")
    again = F.when(F.col("has_header") & (F.col("b") != ""), headers_alike(F.col("a"), F.col("b"))).otherwise(False)
    both = both.select("left_id", "right_id", F.coalesce(again, F.lit(False)).alias("again"))
    left = both.join(rows, both["left_id"] == rows["fragment_id"]).select("left_id", F.lit(0).alias("part"), "row_index", "cells")
    right = both.join(rows, both["right_id"] == rows["fragment_id"]).where(~F.col("again") | (F.col("row_index") > 0)).select("left_id", F.lit(1).alias("part"), "row_index", "cells")
    every = left.union(right)
    return every.select("left_id", (F.row_number().over(Window.partitionBy("left_id").orderBy("part", "row_index")) - 1).alias("row_index"), "cells")


# A fixed value: what a heading between two tables looks like.
HEADING = r"(?m)^(?:#{1,6}\s+\S|第[一二三四五六七八九十百0-9]+[章节]\s*|\p{Nd}+(?:\.\p{Nd}+)+\s+\S)"


def _after(content: Column, part: Column) -> Column:
    at = F.instr(content, part)
    return F.when(at > 0, F.substring(content, at + F.char_length(part), F.char_length(content))).otherwise("")


def _before(content: Column, part: Column) -> Column:
    at = F.instr(content, part)
    return F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(content)


def _put(content: Column, part: Column, by: Column) -> Column:
    """The first occurrence replaced."""
    at = F.instr(content, part)
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), by, _after(content, part))).otherwise(content)


def heading_between(pairs: DataFrame, pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """The pairs (content_id, left_id, right_id) with ``blocked``: a heading stands after the left table on its page, or before
    the right one on its own. From pages (content_id, page_number, content) and fragments (…, fragment_id, rendered)."""
    placed = fragments.select("content_id", "page_number", "fragment_id", "rendered").join(pages.select("content_id", "page_number", "content"), ["content_id", "page_number"])
    left = placed.select("content_id", F.col("fragment_id").alias("left_id"), F.col("page_number").alias("left_page"), _after(F.col("content"), F.col("rendered")).alias("tail"))
    right = placed.select("content_id", F.col("fragment_id").alias("right_id"), F.col("page_number").alias("right_page"), _before(F.col("content"), F.col("rendered")).alias("head"))
    both = pairs.join(left, ["content_id", "left_id"]).join(right, ["content_id", "right_id"])
    return both.withColumn("blocked", F.concat_ws("\n", "tail", "head").rlike(HEADING)).drop("tail", "head")


def logical_tables(pages: DataFrame, fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """The pages with the tables that go on across pages joined: the first part's place takes the whole, the second's is
    left blank. Fragments have what cross_page_link reads, and ``rendered``, their text on the page; rows are
    (fragment_id, row_index, cells, has_header)."""
    links = heading_between(cross_page_link(fragments), pages, fragments).where("NOT blocked")
    links = links.select("content_id", "left_id", "right_id", "left_page", "right_page")
    name = F.concat(F.lit("table_"), F.col("left_id").cast("string"), F.lit("_"), F.col("right_id").cast("string"))
    note = F.concat(F.lit("<!-- logical-table: "), name, F.lit("; source-pages: "), F.concat_ws(",", "left_page", "right_page"), F.lit(" -->\n\n"))
    merged = gfm_render(merged_rows(links.select("left_id", "right_id"), rows), ["left_id"])
    whole = links.join(merged, "left_id").select("content_id", F.col("left_page").alias("page_number"), F.col("left_id").alias("fragment_id"), F.concat(note, "markdown").alias("by"))
    gone = links.select("content_id", F.col("right_page").alias("page_number"), F.col("right_id").alias("fragment_id"), F.lit("").alias("by"))
    # a page has at most two such tables: its first and its last
    changes = whole.union(gone).join(fragments.select("content_id", "fragment_id", "rendered", "ordinal"), ["content_id", "fragment_id"])
    listed = changes.groupBy("content_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rendered", "by"))).alias("changes"))
    done = F.aggregate(F.coalesce("changes", F.array().cast("array<struct<ordinal:bigint,rendered:string,by:string>>")), F.coalesce("content", F.lit("")), lambda text, x: _put(text, x["rendered"], x["by"]))
    return pages.join(listed.withColumn("changes", F.col("changes").cast("array<struct<ordinal:bigint,rendered:string,by:string>>")), ["content_id", "page_number"], "left").withColumn("content", done).drop("changes")


def anchored(cells: list[tuple[int, int, int, int]], rows: int, columns: int) -> tuple[list[bool], list[str]]:
    """Which cells (row, row after, column, column after) take their place, in order of arrival, and why others do not."""
    if not (0 < rows <= 2000 and 0 < columns <= 100):
        return [False] * len(cells), ["invalid_dimensions"]
    taken = [0] * rows  # a bit for each column
    kept, reasons = [], {}
    for top, bottom, left, right in cells:
        mask = ((1 << max(right - left, 0)) - 1) << max(left, 0)
        if not (0 <= top < bottom <= rows and 0 <= left < right <= columns):
            why = "cell_out_of_bounds"
        elif any(t & mask for t in taken[top:bottom]):
            why = "overlapping_cells"
        else:
            why = None
            taken[top:bottom] = [t | mask for t in taken[top:bottom]]
        kept.append(why is None)
        if why:
            reasons[why] = None
    return kept, list(reasons)


def grid_anchor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per table (keys, num_rows, num_cols): the kept cells and the reasons for those that are not, from cells (arrival,
    top, bottom, left, right). A table's cells are gathered in its row: 200,000 at most can have a place."""

    @F.arrow_udf(StructType([StructField("kept", ArrayType(BooleanType())), StructField("reasons", ArrayType(StringType()))]))
    def place(groups: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
        out = [anchored([(x["top"], x["bottom"], x["left"], x["right"]) for x in g], r, c) for g, r, c in zip(groups.to_pylist(), rows.to_pylist(), columns.to_pylist(), strict=True)]
        return pa.array([{"kept": k, "reasons": w} for k, w in out], pa.struct([("kept", pa.list_(pa.bool_())), ("reasons", pa.list_(pa.string()))]))

    listed = cells.groupBy(*keys, "num_rows", "num_cols").agg(F.array_sort(F.collect_list(F.struct("arrival", "top", "bottom", "left", "right"))).alias("g"))
    got = listed.withColumn("p", place("g", "num_rows", "num_cols"))
    arrivals = F.transform(F.filter(F.arrays_zip(F.col("g.arrival").alias("a"), F.col("p.kept").alias("k")), lambda x: x["k"]), lambda x: x["a"])
    return got.select(*keys, arrivals.alias("arrivals"), F.col("p.reasons").alias("reasons"))


def parallel_split(tables: DataFrame) -> DataFrame:
    """Tables of even width of eight or more that stand alone become a left and a right half."""
    split = (F.size("columns") >= 8) & (F.size("columns") % 2 == 0) & F.col("hint")
    half = (F.size("columns") / 2).cast("int")
    sides = F.when(split, F.array(F.struct(F.lit("left").alias("side"), F.slice("columns", 1, half).alias("columns")), F.struct(F.lit("right").alias("side"), F.slice("columns", half + 1, half).alias("columns")))).otherwise(F.array(F.struct(F.lit("single").alias("side"), F.col("columns").alias("columns"))))
    return tables.select("table_id", F.explode(sides).alias("s")).select("table_id", "s.side", "s.columns")
