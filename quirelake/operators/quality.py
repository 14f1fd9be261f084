"""Quality rules: each is one predicate with a public code; statuses, verdicts and summaries follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions.pyfuncs import char_coverage

# Fixed values from here to _VALUE: codes and patterns that results must use as they are.
#: Codes that make a page without visual fusion untrusted.
DISTRUST = [
    "low_text_content", "high_replacement_character_ratio", "repeated_text", "suspicious_unicode_mojibake",
    "suspicious_unicode_glyphs", "native_identifier_missing", "native_heading_order_mismatch", "reading_order_inversion",
    "table_shape_explosion", "table_header_propagation", "unanchored_table_numbers", "visual_text_mismatch",
]
#: Codes that make a fused page untrusted.
FUSED_DISTRUST = ["qwen_response_truncated", "visual_fusion_partial", "visual_fusion_timeout", "table_structure_invalid"]
#: Codes beside errors that make a document unacceptable.
UNACCEPTABLE = [*DISTRUST, "qwen_response_truncated", "visual_fusion_partial", "visual_fusion_timeout", "unresolved_visual_conflict"]
INFO = ["intentional_sparse_page", "rotated_scan"]
_LINKS = "(?i)^(?:(?:来源|参考)链接|链接)(?:地址)?[：:]?$|^巨潮资讯网[（）()]*$"
_URL = r"(?i)https?://[^\s|）)]+"
#: Characters that a text layer should not hold.
GLYPHS = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\x{FFFD}]"
_DECIMAL = r"^[-−]?\(?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)%?\)?$"
_VALUE = r"^[-−]?\(?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?\)?$"


def most_repeats(values: Column) -> Column:
    """How often the most frequent value of an array occurs: runs of the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x == s["last"], s["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["most"])


def repeat_count(content: Column, least: int = 5) -> Column:
    """How often the most frequent short piece of prose outside tables and comments occurs; null below ``least``."""
    prose = F.regexp_replace(T.plain_lines(content), _URL, "")
    parts = F.transform(F.split(prose, r"[\n。！？.!?]+"), T.strip)
    linked = lambda f: F.lower(f).contains("http://") | F.lower(f).contains("https://") | F.lower(f).contains("www.")
    some = F.filter(parts, lambda f: F.char_length(f).between(4, 120) & ~F.translate(f, " \t", "").rlike(_LINKS) & ~linked(f))
    most = most_repeats(some)
    return F.when(most >= least, most)


def repeat_fragments(pages: DataFrame, keys: list[str], content: str = "content", least: int = 5) -> DataFrame:
    """Pages on which a fragment occurs ``least`` times or more, and the most that one occurs. A page is one row; nothing is exchanged."""
    return pages.select(*keys, repeat_count(F.col(content), least).cast("long").alias("repeat_count")).where("repeat_count is not null")


def table_rows(content: Column) -> Column:
    return F.filter(T.lines(content), lambda l: F.trim(l).startswith("|") & (F.char_length(l) - F.char_length(F.replace(l, F.lit("|"), F.lit(""))) >= 2))


def row_cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def repeated_cell(rows: Column, least: int = 5) -> Column:
    """Whether one of the table rows repeats one non-numeric cell too often."""
    words = lambda row: F.filter(row_cells(row), lambda c: (c != "") & ~c.rlike(r"^[-: ]+$") & ~c.isin("不适用", "不適用", "N/A", "n/a") & ~c.rlike(_VALUE))
    most = lambda cells: F.array_max(F.transform(F.array_distinct(cells), lambda c: F.size(F.filter(cells, lambda x: x == c))))
    return F.exists(F.transform(rows, words), lambda cells: F.coalesce(most(cells) >= least, F.lit(False)))


def widest_row(rows: Column) -> Column:
    return F.array_max(F.transform(rows, lambda l: F.char_length(l) - F.char_length(F.replace(l, F.lit("|"), F.lit(""))) - 1))


def unanchored_numbers(lines: Column, rows: Column) -> Column:
    """Whether a number that stands on a line of its own, outside tables, is one of a cell of the table rows too."""
    outside = F.filter(lines, lambda l: ~T.strip(l).startswith("|") & T.strip(l).rlike(_DECIMAL))
    return (F.size(rows) > 0) & F.arrays_overlap(T.number_tokens(F.array_join(rows, "\n")), T.number_tokens(F.array_join(outside, "\n")))


def suspicious_glyphs(content: Column) -> Column:
    """Replacement, control, format, private-use and surrogate characters, but for line breaks and tabs."""
    return F.translate(content, "\n\t", "").rlike(GLYPHS)


def glyph_counts(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, glyph, n): how often each suspicious character occurs, named by its code point. Only those characters leave the row."""
    found = F.regexp_extract_all(F.translate(content, "\n\t", ""), F.lit(f"({GLYPHS})"), F.lit(1))
    each = pages.select(*keys, F.explode(found).alias("c"))
    code = F.hex(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long"))
    code = F.concat(F.lit("U+"), F.when(F.char_length(code) < 4, F.lpad(code, 4, "0")).otherwise(code))
    return each.groupBy(*keys, code.alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


def _given(pages: DataFrame, column: str, default) -> Column:
    """A column that may be missing."""
    return F.col(column) if column in pages.columns else F.lit(default)


def page_codes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``codes`` (sorted) to pages with content, status, source_kind, rotation and native_chars, and if there are
    such columns, strategy (only docling's text is held against the native one) and known, the codes found before.

    A page is one row and stays one; nothing is exchanged."""
    rows = pages.withColumn("content", T.strip(F.coalesce("content", F.lit(""))))
    # several rules look at them
    rows = rows.withColumn("__lines", T.lines(F.col("content"))).withColumn("__rows", table_rows(F.col("content")))
    empty, live = F.col("content") == "", F.coalesce(F.col("status") != "failed", F.lit(True))
    sparse = F.coalesce(F.col("source_kind") == "sparse", F.lit(False))
    docling = F.coalesce(_given(pages, "strategy", "docling"), F.lit("docling")) == "docling"
    rules = {
        "no_usable_content": empty & live,
        "intentional_sparse_page": sparse & ~empty & live,
        "low_text_content": ~sparse & ~empty & live & (F.char_length("content") < 12),
        "high_replacement_character_ratio": live & (T.replacement_ratio(F.col("content")) > 0.02),
        "repeated_text": live & repeat_count(F.col("content")).isNotNull(),
        "unanchored_table_numbers": live & unanchored_numbers(F.col("__lines"), F.col("__rows")),
        "table_header_propagation": live & repeated_cell(F.col("__rows")),
        "table_shape_explosion": live & (widest_row(F.col("__rows")) > 24),
        "rotated_scan": ~empty & live & F.col("rotation").isin(90, 180, 270),
        "visual_text_mismatch": ~empty & live & (F.col("source_kind") == "native") & docling & (F.col("native_chars") > 0) & (F.char_length(F.regexp_replace("content", T.WS, "")) < F.col("native_chars") * 0.2),
        "suspicious_unicode_mojibake": live & T.mojibake(F.col("content")),
        "suspicious_unicode_glyphs": live & suspicious_glyphs(F.col("content")),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items())))
    if "known" in pages.columns:
        found = F.array_union(F.coalesce("known", F.array().cast("array<string>")), found)
    return rows.withColumn("codes", F.array_sort(found)).drop("__lines", "__rows")


def assess(pages: DataFrame) -> DataFrame:
    """Adds the final status and verdict to pages with ``codes``, ``fused`` and ``conflicts``. A page without diagnostics
    (``measured`` is false, if there is such a column) is judged by its status alone."""
    failed = (F.col("status") == "failed") | F.array_contains("codes", "no_usable_content")
    acts = F.size(F.array_except("codes", F.array(*map(F.lit, INFO)))) > 0
    status = F.when(failed, "failed").when((F.col("status") == "completed") & acts, "warning").otherwise(F.col("status"))
    has = lambda codes: F.arrays_overlap("codes", F.array(*map(F.lit, codes)))
    by_status = F.when(F.col("status2").isin("warning", "failed"), "untrusted").otherwise("trusted")
    fused = F.when((F.col("status2") == "failed") | has(FUSED_DISTRUST), "untrusted").when((F.coalesce("conflicts", F.lit(0)) > 0) | (F.col("status2") == "warning"), "degraded").otherwise("trusted")
    plain = F.when(F.col("status2").isin("warning", "failed") | has(DISTRUST), "untrusted").otherwise("trusted")
    verdict = F.when(F.col("fused"), fused).otherwise(plain)
    verdict = F.when(_given(pages, "measured", True), verdict).otherwise(by_status)
    return pages.withColumn("status2", status).withColumn("verdict", verdict).drop("status").withColumnRenamed("status2", "status")


def quality_summary(pages: DataFrame, key: str) -> DataFrame:
    """Per content: pages by verdict, failed, repaired and visual ones, calls and conflicts, and whether the whole is acceptable.
    Pages have what assess gives them, fused and conflicts; measured, strategy, calls and resolved may be missing."""
    bad = F.arrays_overlap("codes", F.array(*map(F.lit, [*UNACCEPTABLE, "no_usable_content"])))
    measured = _given(pages, "measured", True)
    visual = measured & F.col("fused")
    total = lambda c: F.sum(F.when(visual, F.coalesce(_given(pages, c, 0), F.lit(0))).otherwise(0)).cast("long")
    return pages.groupBy(key).agg(
        F.count_if(F.col("verdict") == "trusted").alias("trusted_pages"),
        F.count_if(F.col("verdict") == "degraded").alias("degraded_pages"),
        F.count_if(F.col("verdict") == "untrusted").alias("untrusted_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.bool_and((F.col("status") != "failed") & ~bad).alias("acceptable"),
        F.count_if(measured & (_given(pages, "strategy", "docling") != "docling")).alias("repaired_pages"),
        F.count_if(visual).alias("visual_pages"),
        total("calls").alias("calls"),
        total("resolved").alias("resolved_conflicts"),
        total("conflicts").alias("unresolved_conflicts"),
    )


def warning_union(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Known warnings and those found whose keys are new; repeats among the found stay."""
    return known.unionByName(found.join(known.select(*keys).distinct(), keys, "left_anti"))


def char_multiset_coverage(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """Share of the reference's characters, with repeats, that the candidate has. A pair is one row and nothing is exchanged."""
    return pairs.select(key, char_coverage(T.compact_text(F.col(reference)), T.compact_text(F.col(candidate))).alias("coverage"))


def multiset_intersect(rows: DataFrame, key: str, token: str, side: str) -> DataFrame:
    """Number of tokens that both sides (0 and 1) have, with repeats."""
    n = rows.groupBy(key, token).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    return n.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))


def manifest_check(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Required but missing and present but not allowed codes of each scope."""
    rows = expected.join(actual, keys, "left")
    have = F.coalesce("codes", F.array().cast("array<string>"))
    return rows.select(*keys, F.array_sort(F.array_except("required", have)).alias("missing"), F.array_sort(F.array_except(F.array_except(have, "allowed"), "required")).alias("unexpected"))


def repeated_lines_dropped(lines: DataFrame, keys: list[str], order: str, text: str, extra: DataFrame) -> DataFrame:
    """Per page and line text, the first occurrence stays and up to ``n`` later ones go (extra: keys, norm, n)."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*(?:#{1,6}|[-+*])\s+", ""), r"\s+", " "))
    rows = lines.withColumn("norm", norm).join(extra, [*keys, "norm"], "left")
    place = F.row_number().over(Window.partitionBy(*keys, "norm").orderBy(order))
    return rows.withColumn("place", place).where(F.col("n").isNull() | (F.col("place") == 1) | (F.col("place") > F.col("n") + 1)).drop("place", "norm", "n")
