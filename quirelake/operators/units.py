"""Units (pages, slides, frames): selections as text, runs, neighbours, routing by measured evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The form of an item here, and the thresholds in the functions below.
_ITEM = r"^[1-9][0-9]*(\s*-\s*[1-9][0-9]*)?$"


def unit_range_expand(rows: DataFrame, limit: int = 100_000) -> DataFrame:
    """(id, value, total) -> one row per selected unit, or one with an error code. Null or blank selects all."""
    items = F.transform(F.split("value", ","), lambda x: F.trim(x))
    blank = F.col("value").isNull() | (F.trim("value") == "")
    bounds = F.transform("items", lambda x: F.struct(F.regexp_extract(x, r"^[0-9]+", 0).try_cast("long").alias("a"), F.regexp_extract(x, r"[0-9]+$", 0).try_cast("long").alias("b")))
    error = (
        F.when(blank, None)
        .when(F.exists("items", lambda x: x == ""), "empty_item")
        .when(F.exists("items", lambda x: ~x.rlike(_ITEM)), "invalid_item")
        .when(F.exists("bounds", lambda x: x["a"] > x["b"]), "reversed")
        .when(F.exists("bounds", lambda x: x["b"] > F.col("total")), "beyond_total")
        .when(F.aggregate("bounds", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"] + 1) > limit, "too_many")
    )
    rows = rows.withColumn("items", items).withColumn("bounds", bounds).withColumn("blank", blank).withColumn("error", error)
    chosen = F.when(F.col("blank"), F.sequence(F.lit(1).cast("long"), F.col("total"))).otherwise(
        F.array_sort(F.array_distinct(F.flatten(F.transform("bounds", lambda x: F.sequence(x["a"], x["b"])))))
    )
    units = F.when(F.col("error").isNull(), chosen).otherwise(F.array(F.lit(None).cast("long")))
    return rows.withColumn("u", units).select("id", F.explode("u").alias("unit"), "error")


def consecutive_groups(rows: DataFrame, key: str, unit: str) -> DataFrame:
    """Runs of consecutive units of each key, never across a gap: (key, first, last)."""
    one = rows.select(key, unit).distinct()
    run = F.col(unit) - F.row_number().over(Window.partitionBy(key).orderBy(unit))
    return one.withColumn("run", run).groupBy(key, "run").agg(F.min(unit).alias("first"), F.max(unit).alias("last")).drop("run")


def unit_range_format(rows: DataFrame, key: str, unit: str) -> DataFrame:
    """Units as compact text, like 1-3,5."""
    runs = consecutive_groups(rows, key, unit)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.array_sort(F.collect_list(F.struct("first", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("units"))


def unit_range_contains(value: Column, unit: Column) -> Column:
    """Membership without expansion; any invalid item makes it false."""
    items = F.transform(F.split(value, ","), lambda x: F.trim(x))
    inside = F.exists(items, lambda x: (F.regexp_extract(x, r"^[0-9]+", 0).try_cast("long") <= unit) & (F.regexp_extract(x, r"[0-9]+$", 0).try_cast("long") >= unit))
    return F.coalesce(F.forall(items, lambda x: x.rlike(_ITEM)) & inside, F.lit(False))


def nearby_units(rows: DataFrame, key: str, unit: str, total: str) -> DataFrame:
    """Each unit with its neighbours inside the bounds."""
    near = rows.select(key, total, F.explode(F.array(F.col(unit) - 1, F.col(unit), F.col(unit) + 1)).alias("unit"))
    return near.where((F.col("unit") >= 1) & (F.col("unit") <= F.col(total))).select(key, "unit").distinct()


def page_source_kind(chars: Column, cover: Column, ink: Column) -> Column:
    """sparse, native, scanned or mixed; ink counts as measured only where it is not null."""
    few = chars < 40
    return (
        F.when(few & (cover < 0.05) & F.coalesce(ink < 0.015, F.lit(False)), "sparse")
        .when((chars >= 40) & (cover < 0.20), "native")
        .when(few & ((cover >= 0.80) | F.coalesce(ink >= 0.03, F.lit(False))), "scanned")
        .otherwise("mixed")
    )


def image_class(chars: Column, cover: Column, ink: Column, measured: Column) -> Column:
    """document, mixed, visual or unknown; without measured evidence the text alone decides."""
    cover, ink = F.coalesce(cover, F.lit(0.0)), F.coalesce(ink, F.lit(0.0))
    by_text = F.when(chars >= 80, "document").when(chars >= 15, "mixed").when(chars == 0, "visual").otherwise("unknown")
    dense = (chars >= 80) | ((chars >= 40) & (ink >= 0.02) & (cover >= 0.55))
    by_all = F.when(dense, "document").when(chars >= 15, "mixed").when((cover >= 0.4) | (ink < 0.08), "visual").otherwise("unknown")
    return F.when(measured, by_all).otherwise(by_text)


def complex_grid(h: Column, v: Column) -> Column:
    return (h >= 3) & (v >= 3)


def rotation_guess(h: Column, v: Column, grid_w: Column, grid_h: Column, width: Column, height: Column, default: Column) -> Column:
    """Turn of a scanned page by its ruled lines and proportions, else the page's own."""
    guess = (
        F.when((v >= 3) & (v > 1.35 * h) & (grid_h > 1.1 * grid_w), 90)
        .when(width > 1.1 * height, 0)
        .when((h >= 3) & (h > 1.35 * v), 0)
    )
    return F.coalesce(guess, default)


def visual_target(kind: Column, h: Column, v: Column, grid_area: Column, failed: Column, regions: Column, hint: Column, placeholder: Column, cover: Column, repeated: Column) -> Column:
    """Which scanned or mixed pages are worth an expensive look: table, signature or null."""
    table = (complex_grid(h, v) & (grid_area >= 0.25)) | (failed & (regions > 0))
    signature = hint & (placeholder | (cover >= 0.20) | repeated)
    return F.when(kind.isin("scanned", "mixed"), F.when(table, "table").when(signature, "signature"))


def route(mode: Column, mime: Column, size: Column, units: Column) -> Column:
    """async where asked for, for video, and beyond 20 MiB or 10 units."""
    return F.when((mode == "async") | mime.startswith("video/") | (size > 20 * 1024 * 1024) | (units > 10), "async").otherwise("sync")


def profile_settings(profile: Column, ocr_scale: Column) -> tuple[Column, Column, Column]:
    """(policy for expensive looks, scale of renderings, scale of OCR) of a profile."""
    fast, accurate = profile == "fast", profile == "accurate"
    ocr = F.when(fast, F.least(ocr_scale, F.lit(2.0))).when(accurate, F.greatest(ocr_scale, F.lit(3.0))).otherwise(ocr_scale)
    return F.when(accurate, "auto_visual").otherwise("off"), F.when(fast, 1.5).when(accurate, 2.5).otherwise(2.0), ocr


_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def selection_error(mime: Column, value: Column) -> Column:
    """Video takes no range; text documents and single images take none or exactly 1."""
    single = (mime == _WORD) | (mime.startswith("image/") & (mime != "image/tiff"))
    return F.when(mime.startswith("video/") & value.isNotNull(), "invalid_unit_range").when(single & value.isNotNull() & (value != "1"), "invalid_unit_range")


def progress_unit(mime: Column) -> Column:
    return F.when(mime.contains("presentationml"), "slide").when(mime.startswith("video/"), "frame").when(mime.isin("application/pdf", "image/tiff"), "page").otherwise("asset")


def source_kind_norm(name: Column) -> Column:
    """The family of an evidence source by its name."""
    x = F.lower(name)
    return (
        F.when(x.contains("qwen") | x.contains("vlm"), "qwen")
        .when(x.contains("glm") | x.contains("sdk"), "glm")
        .when(x.contains("native") | x.contains("pymupdf"), "native")
        .otherwise("docling")
    )
