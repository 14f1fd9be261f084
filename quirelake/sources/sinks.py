"""Sinks: results in three renderings, event frames, byte ranges, content-addressed assets, upserts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T


def sse_emit(event_id: Column, event: Column, data: Column) -> Column:
    """A frame as it is sent."""
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def byte_range(header: Column, size: Column) -> tuple[Column, Column, Column]:
    """(start, end, error) of a single byte range, also in suffix form."""
    ok = header.rlike(r"^bytes=([0-9]+-[0-9]*|-[0-9]+)$")
    first, last = F.regexp_extract(header, r"^bytes=([0-9]*)-", 1), F.regexp_extract(header, r"-([0-9]*)$", 1)
    start = F.when(first != "", first.try_cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), size - last.try_cast("long")))
    end = F.when(first == "", size - 1).when(last != "", last.try_cast("long")).otherwise(size - 1)
    error = F.when(~ok, "invalid_range").when((end < start) | (start >= size), "range_not_satisfiable")
    return F.when(error.isNull(), start), F.when(error.isNull(), F.least(end, size - 1)), error


def document_rendering(pages: DataFrame, key: str, breaks: bool = True) -> DataFrame:
    """Pages in order, normalised: Markdown, and plain text of it. With breaks, pages have a mark of their number, and form feeds between."""
    md = T.markdown_normalized(F.coalesce("content", F.lit("")))
    rows = pages.select(key, "page_number", md.alias("md")).withColumn("txt", T.markdown_to_text(F.col("md")))
    mark = lambda a, b, c: T.right_strip(F.concat(F.lit(a), F.col("page_number").cast("string"), F.lit(b), F.col(c))) if breaks else F.col(c)
    rows = rows.select(key, "page_number", mark("<!-- page: ", " -->\n\n", "md").alias("md"), mark("--- Page ", " ---\n\n", "txt").alias("txt"))
    listed = F.array_sort(F.collect_list(F.struct("page_number", "md", "txt")))
    joined = lambda c: T.strip(F.array_join(F.transform(listed, lambda p: p[c]), "\n\n\f\n\n" if breaks else "\n\n"))
    return rows.groupBy(key).agg(joined("md").alias("markdown"), joined("txt").alias("plain_text"))


def write_results(results: DataFrame, path: str, key: str = "content_id") -> None:
    """JSON, Markdown, text and warnings beside each other; each write is atomic by its commit protocol."""
    for name in ("result", "markdown", "plain_text"):
        results.select(key, name).write.mode("overwrite").parquet(f"{path}/{name}")
    results.where(F.size("warnings") > 0).select(key, "warnings").write.mode("overwrite").parquet(f"{path}/warnings")


def new_assets(assets: DataFrame, existing: DataFrame) -> DataFrame:
    """Assets whose digest is not stored yet, one each."""
    return assets.withColumn("sha256", F.sha2("content", 256)).join(existing.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def verified_bundle(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets whose stored bytes still have their digest; the rest is left out."""
    return assets.join(files.select(F.sha2("content", 256).alias("sha256")).distinct(), "sha256", "left_semi")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows with the last change of each key in place."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*current.columns), order).alias("r")).select("r.*")
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def purge_counts(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """What a purge would remove, by status; jobs that still run stay."""
    gone = (F.col("expires_at") <= cutoff) & F.col("status").isin("completed", "partial", "failed", "cancelled")
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("removed"))
