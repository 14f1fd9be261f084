"""Small rules around documents and jobs: projections, gates, names, limits, formats. Columns in, columns out, where a row is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.jobs import TERMINAL

# Codes, names, texts and addresses that results must use as they are.
TOO_LARGE, BAD_REQUEST = ["file_too_large", "too_many_pages"], ["empty_file", "empty_document", "invalid_pdf", "invalid_image"]
RETRYABLE = ["failed", "partial", "cancelled"]
READY = ["ready", "healthy", "ok", "available"]
UNAVAILABLE = ["unavailable", "degraded", "error", "failed"]
ALIASES = {"docling": "docling", "docling-standard": "docling", "glm": "glm", "glm_ocr": "glm", "glm-ocr-remote": "glm", "vlm": "vlm", "ollama": "vlm", "ollama_vlm": "vlm"}
LANGUAGE_TEXTS = {
    "zh-CN": "Write every natural-language output field in Simplified Chinese and set the language field to zh-CN. Do not answer in English.",
    "en": "Write every natural-language output field in English and set the language field to en.",
    "auto": "Use the main language visible in the image or sampled frames.",
}
DOCUMENT_TEXTS = {
    "en": ("This image primarily contains parseable document content.", "Its content was extracted through the document layout and text path."),
    "": ("该图片主要包含可解析的文档内容。", "内容已通过文档布局与文字解析路径提取。"),
}
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
EXTENSIONS = {
    "application/pdf": [".pdf"],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": [".docx"],
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": [".pptx"],
    "image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"], "image/webp": [".webp"], "image/tiff": [".tif", ".tiff"], "image/bmp": [".bmp"],
    "video/mp4": [".mp4"], "video/quicktime": [".mov"], "video/x-matroska": [".mkv"], "video/webm": [".webm"], "video/x-msvideo": [".avi"],
}
OFFICE = [m for m in EXTENSIONS if m.startswith("application/vnd.")]
LINKS = ("events", "result", "assets", "bundle")


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


# ---- inputs


def extension_agreement(name: Column, mime: Column) -> tuple[Column, Column]:
    """(name, error): a missing extension is appended, one that the type does not have is an error."""
    table = F.create_map(*(x for m, es in EXTENSIONS.items() for x in (F.lit(m), F.array(*map(F.lit, es)))))
    allowed, suffix = table[mime], F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    error = F.when(mime.isNull() | allowed.isNull(), "unsupported_file_type").when((suffix != "") & ~F.array_contains(allowed, suffix), "file_type_mismatch")
    return F.when(error.isNull(), F.when(suffix == "", F.concat(name, allowed[0])).otherwise(name)), error


def file_error(size: Column, header_error: Column, units: Column, mime: Column, most_bytes: int = 200 * 1024 * 1024, most_units: int = 1000) -> Column:
    """The first check that fails, in order: empty, too large, what the header says, too many units."""
    return F.coalesce(
        F.when(size <= 0, "empty_file"), F.when(size > most_bytes, "file_too_large"), header_error, F.when(~mime.startswith("video/") & (units > most_units), "too_many_units")
    )


def validation_status(code: Column) -> Column:
    return F.when(code.isin(*BAD_REQUEST), 400).when(code.isin(*TOO_LARGE), 413).otherwise(415)


def pipeline_of(mime: Column) -> Column:
    """Which of the three paths takes an input."""
    return F.when(mime.startswith("video/"), "video").when(mime.isin(*OFFICE), "office").otherwise("pages")


def split_pipelines(rows: DataFrame, mime: str = "mime") -> dict[str, DataFrame]:
    """One table for each path."""
    return {name: rows.where(pipeline_of(F.col(mime)) == name) for name in ("video", "office", "pages")}


def download_filename(disposition: Column, url: Column) -> Column:
    """The name a response gives, else the last part of the URL's path, else a fixed one."""
    said = F.coalesce(F.nullif(F.regexp_extract(disposition, r'(?i)filename="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(disposition, r"(?i)filename=([^;\s\"]+)", 1), F.lit("")))
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)$", 1)
    last = F.nullif(F.element_at(F.split(F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/+$", ""), "/"), -1), F.lit(""))
    return F.coalesce(said, last, F.lit("document"))


def download_header(name: Column, suffix: str) -> Column:
    """How a result is offered for download: a plain name, and the whole one, encoded."""
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    stem = F.when(stem == "", "content").otherwise(stem)
    plain = F.regexp_replace(stem, "[^A-Za-z0-9]", "")
    encoded = F.replace(F.replace(F.url_encode(F.concat(stem, F.lit(suffix))), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("attachment; filename="), F.when(plain == "", "content").otherwise(plain), F.lit(f"{suffix}; filename*=UTF-8''"), encoded)


def safe_id(value: Column) -> Column:
    """Whether a text may name a folder of a content."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"), F.lit(False))


def shell_quote(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


# ---- jobs


def links(job: Column) -> Column:
    base = F.concat(F.lit("/v1/content/jobs/"), job)
    return F.struct(base.alias("job"), *(F.concat(base, F.lit(f"/{x}")).alias(x) for x in LINKS))


def job_response(jobs: DataFrame) -> DataFrame:
    """What a job shows of itself: paths and other private columns stay out."""
    url = links(F.col("id"))
    kept = [c for c in ("status", "filename", "mime_type", "attempt", "parent_job_id", "created_at", "started_at", "completed_at") if c in jobs.columns]
    return jobs.select("id", *kept, url["job"].alias("status_url"), *(url[x].alias(f"{x}_url") for x in LINKS))


def retry_error(status: Column, source_there: Column) -> Column:
    return F.when(~status.isin(*RETRYABLE), "job_not_retryable").when(~source_there, "source_expired")


def unit_retryable(status: Column, kind: Column) -> Column:
    return status.isin("failed", "warning") & (kind != "video")


def delete_action(status: Column) -> Column:
    """An active job is cancelled, an ended one deleted."""
    return F.when(status.isin("queued", "running"), "cancelled").when(status.isin(*TERMINAL), "deleted")


def result_error(status: Column, there: Column, version: Column, wanted: str = "content-parse-result/1.0") -> Column:
    """Why a result can not be read: not finished, not there, or of a retired form."""
    return F.when(~status.isin("completed", "partial"), "result_not_ready").when(~there, "result_missing").when(F.coalesce(version, F.lit("")) != wanted, "legacy_result_contract")


def sync_error(busy: Column, workers: Column) -> Column:
    """A request that wants its answer at once is refused when all slots are taken, not queued."""
    return F.when(busy >= workers, "sync_capacity_exceeded")


def progress_percent(current: Column, total: Column) -> Column:
    """One decimal, ties to the even digit of the exact value, at most 100."""
    share = F.least(F.lit(100.0), current * F.lit(100.0) / total)
    return F.when(total <= 0, 0.0).otherwise(F.bround(share, 1))


def reconnect_delay(attempt: Column, base: int = 750, most: int = 15_000) -> Column:
    n = F.least(F.greatest(F.floor(attempt), F.lit(0)), F.lit(40))
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), n)).cast("long")


def ulid(prefix: str, at_ms: Column, random: Column) -> Column:
    """A name that sorts by time: 48 bits of milliseconds, and 80 random bits (20 hex digits), in base 32."""
    digit = lambda v: F.substring(F.lit(CROCKFORD), (v + 1).cast("int"), F.lit(1))
    time = [digit(F.shiftright(at_ms.bitwiseAND(F.lit((1 << 48) - 1)), 5 * k).bitwiseAND(F.lit(31))) for k in range(9, -1, -1)]
    halves = [F.conv(F.substring(random, p, 10), 16, 10).cast("long") for p in (1, 11)]
    rest = [digit(F.shiftright(h, 5 * k).bitwiseAND(F.lit(31))) for h in halves for k in range(7, -1, -1)]
    return F.concat(F.lit(f"{prefix}_"), *time, *rest)


def iso_time(at: Column) -> Column:
    """UTC, with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


# ---- pages


def block_text(spans: DataFrame, keys: list[str]) -> DataFrame:
    """From spans (keys, line, span, text, font, size): each block's lines, largest size, boldness, and the check mark that one
    symbol font hides behind a private character."""
    lines = spans.groupBy(*keys, "line").agg(
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")).alias("t"),
        F.max("size").alias("size"), F.bool_or(F.lower("font").contains("bold") | F.col("font").contains("黑体")).alias("bold"),
        F.bool_or(F.lower("font").contains("wingdings 2") & F.col("text").contains("\uf052")).alias("mark"),
    )
    listed = F.filter(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"] != "")
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"), F.coalesce(F.max("size"), F.lit(0.0)).alias("max_size"), F.bool_or("bold").alias("bold"),
        F.when(F.bool_or("mark"), F.create_map(F.lit("\uf052"), F.lit("☑"))).otherwise(F.create_map().cast("map<string,string>")).alias("mappings"),
    )


def refreshed_marker(content: Column, fragment: Column) -> Column:
    """The table below a fragment's marker, as the content has it now; null where there is none."""
    mark = F.concat(F.lit("<!-- table-fragment: "), fragment, F.lit(" -->\n\n"))
    at = F.instr(content, mark)
    rest = F.substring(content, at + F.char_length(mark), F.char_length(content))
    table = F.regexp_extract(rest, r"^((?:\|[^\n]*(?:\n|$))+)", 1)
    return F.when((at > 0) & (table != ""), F.regexp_replace(table, r"\s+$", ""))


def exact_lines_removed(content: Column, removals: Column) -> Column:
    """Without the lines whose normalised text is among the removals."""
    keys = F.filter(F.transform(removals, T.normalized), lambda k: k != "")
    return T.strip(F.array_join(F.filter(T.lines(content), lambda line: ~F.array_contains(keys, T.normalized(line))), "\n"))


def short_cjk_line(line: Column) -> Column:
    """A line of one to three CJK characters and nothing else."""
    return T.normalized(line).rlike(r"^[㐀-鿿]{1,3}$")


def measured_analysis(kind: Column, seen: Column, described: Column, described_text: Column, language: Column) -> tuple[Column, Column]:
    """(summary, visible text) of an image: documents get a fixed text and what was read; of others the longer text counts."""
    document = kind == "document"
    english = DOCUMENT_TEXTS["en"][0]
    longer = F.char_length(T.strip(F.coalesce(seen, F.lit("")))) > F.char_length(T.strip(F.coalesce(described_text, F.lit(""))))
    return F.when(document, F.when(language == "en", english).otherwise(DOCUMENT_TEXTS[""][0])).otherwise(described), F.when(document | longer, seen).otherwise(described_text)


def language_instruction(language: Column) -> Column:
    return _lookup(language, LANGUAGE_TEXTS)


def conversion_errors(errors: Column, keep: int = 5, longest: int = 1000) -> Column:
    """From (error_message, message): the first that is not empty, cut; the first few."""
    said = F.transform(errors, lambda e: F.coalesce(F.nullif(e["error_message"], F.lit("")), F.nullif(e["message"], F.lit(""))))
    return F.slice(F.transform(F.filter(said, lambda m: m.isNotNull()), lambda m: F.substring(m, 1, longest)), 1, keep)


def warning_count(details: Column) -> Column:
    """A count of zero or more, if the details have one as a whole number."""
    n = F.get_json_object(details, "$.count")
    return F.when(n.rlike("^[0-9]+$"), n.try_cast("long"))


def crop_box(bbox: Column, width: Column, height: Column, pad: float = 0.01) -> Column:
    """Pixels of a box with a margin that the page has room for; null if nothing is left."""
    px = F.least(F.lit(pad), bbox["left"], 1 - bbox["right"])
    py = F.least(F.lit(pad), bbox["top"], 1 - bbox["bottom"])
    at = lambda v, size: F.bround(v * size).cast("long")
    box = F.struct(at(bbox["left"] - px, width).alias("left"), at(bbox["top"] - py, height).alias("top"), at(bbox["right"] + px, width).alias("right"), at(bbox["bottom"] + py, height).alias("bottom"))
    return F.when((box["right"] - box["left"] >= 2) & (box["bottom"] - box["top"] >= 2), box)


def image_cover(images: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the page that images cover, at most all of it; from (keys, page_width, page_height, x0, y0, x1, y1)."""
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    return images.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(area) / F.greatest(F.lit(1.0), F.max(F.col("page_width") * F.col("page_height")))).alias("cover"))


def pixel_scale(width: Column, height: Column, scale: Column, most: int) -> Column:
    """The scale at which a rendering keeps within a number of pixels."""
    pixels = F.greatest(F.lit(1.0), width * scale * height * scale)
    return F.when(pixels > most, scale * F.sqrt(F.lit(most) / pixels)).otherwise(scale)


def backend_status(status: Column, enabled: Column, available: Column, ready: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(s.isin(*READY), "ready").when((s == "disabled") | F.coalesce(~enabled, F.lit(False)), "disabled")
        .when(s.isin(*UNAVAILABLE) | F.coalesce(~available, F.lit(False)), "unavailable").when(F.coalesce(available, F.lit(False)) | F.coalesce(ready, F.lit(False)), "ready").otherwise("unknown")
    )


def backend_id(name: Column) -> Column:
    """The family of a back end by its name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(_lookup(n, ALIASES), F.when(n.contains("docling"), "docling").when(n.contains("glm"), "glm").when(n.contains("vlm") | n.contains("ollama"), "vlm"), n)


def diagram_error(source: Column, longest: int, most_lines: int) -> Column:
    """Why a diagram's source is refused: the first rule that fails."""
    # the patterns are fixed values
    rules = [
        ("empty", T.strip(source) == ""),
        ("too_long", (F.char_length(source) > longest) | (F.size(F.split(source, r"\r?\n")) > most_lines)),
        ("frontmatter", source.rlike(r"^\s*---\s*(?:\r?\n|$)")),
        ("directive", source.rlike(r"%%\s*\{")),
        ("interaction", source.rlike(r"(?im)^\s*click\b") | source.rlike(r"(?i)\b(?:callback|href)\b")),
        ("style", source.rlike(r"(?im)^\s*(?:classDef|linkStyle|style)\b")),
        ("url", source.rlike(r"(?i)\b(?:https?|ftp|file|data|blob|javascript|vbscript):") | source.rlike(r"(?m)(?:^|[\s\"'(])//[^/\s]")),
        ("embedded", source.rlike(r"!?\[[^\]]*\]\s*\(") | source.rlike(r"(?i)\b(?:img|image)\s*:") | source.rlike(r"(?i)<\s*(?:a|img|image|iframe|foreignObject|script|style)\b")),
    ]
    return F.coalesce(*(F.when(rule, name) for name, rule in rules))


def shown_text(markdown: Column) -> Column:
    """Markdown as a viewer shows it in one breath: all marks go, code stays."""
    # the patterns are fixed values
    out = F.regexp_replace(markdown, r"```[^\n]*\n?((?:(?!```)[\s\S])*)```", "$1")
    for pattern, by in ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*[0-9]+[.)]\s+", "")):
        out = F.regexp_replace(out, pattern, by)
    return T.strip(F.regexp_replace(F.translate(out, "*_~`", ""), r"\n{3,}", "\n\n"))


# ---- joins and limits


def page_children(pages: DataFrame, children: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Pages with their children (tables, pictures) counted and listed in order; pages without any stay."""
    listed = children.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias(f"{name}s"))
    return pages.join(listed, keys, "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.array().cast(dict(listed.dtypes)[f"{name}s"])))


def ordinals(rows: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """The place of each row on its page, from 0, in the order given."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def first_of_each(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key: keyframes for a summary, lines for a look, pictures up to a cap."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= most).drop("__place")


def over_cap(rows: DataFrame, keys: list[str], most: int, code: str) -> DataFrame:
    """Keys with more rows than allowed, which is an error there and no cut."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).withColumn("error", F.lit(code))


def resolved_removed(warnings: DataFrame, resolved: list[str]) -> DataFrame:
    """Warnings whose code is not among those that a later step has resolved."""
    return warnings.where(~F.col("code").isin(*resolved))


def keyframe_assets(frames: DataFrame, assets: DataFrame) -> DataFrame:
    """Keyframes with their picture, if it is there, and its preview, if it has one."""
    preview = assets.where("kind = 'preview'").select(F.col("parent_id").alias("asset_id"), F.col("asset_id").alias("preview_id"))
    there = assets.select("asset_id", F.lit(True).alias("found"))
    return frames.join(there, "asset_id", "left").join(preview, "asset_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def placed_assets(placements: DataFrame, units: DataFrame, assets: DataFrame) -> DataFrame:
    """Where embedded pictures stand: placements of units that are there; excluded ones are skipped."""
    return placements.join(units.where("NOT excluded").select("content_id", "unit_index", "unit_id"), ["content_id", "unit_index"]).join(assets.select("content_id", "relationship_id", "asset_id"), ["content_id", "relationship_id"])


def picture_candidates(pictures: DataFrame, keys: list[str], order: str, most: int = 200) -> DataFrame:
    """Pictures with a box of some size, numbered per page among all of them, up to a cap per content."""
    rows = ordinals(pictures, [*keys, "page_number"], order)
    rows = rows.where((F.col("bbox.right") > F.col("bbox.left")) & (F.col("bbox.bottom") > F.col("bbox.top")))
    return first_of_each(rows, keys, ["page_number", "ordinal"], most)


def stop_after_timeout(calls: DataFrame, key: str) -> DataFrame:
    """Page calls in order: after the first timeout all later pages are skipped."""
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.max(F.col("outcome") == "timeout").over(before), F.lit(False))
    return calls.withColumn("outcome", F.when(skipped, "skipped_after_timeout").otherwise(F.col("outcome")))


def call_budget(calls: DataFrame, keys: list[str], most: int = 3, seconds: float = 180.0) -> DataFrame:
    """Calls of each page in order with what is left before them: a call is made while fewer than ``most`` were made and time is left;
    a truncated answer counts as a call."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("seconds").over(w), F.lit(0.0))
    return calls.withColumn("made", (F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) <= most) & (used < seconds)).withColumn("left", F.greatest(F.lit(0.0), F.lit(seconds) - used))
