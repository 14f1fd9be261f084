"""All queries of the structuring engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import pyfuncs
from quirelake.functions import text as T
from quirelake.operators import fusion, fuzzy, jobs, layout, media, quality, tables, units
from quirelake.plans.inputs import LINES, cte, source
from quirelake.sources import readers, sinks

_W = r"[\s\x0b\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _compact(x: str) -> str:
    return rf"replace(lower(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->|[`#*_~>|\[\](){{}}-]', '', 'g'), '{_W}', '', 'g')), 'ß', 'ss')"


def _norm(x: str) -> str:
    return f"replace(lower(replace(regexp_replace(coalesce({x}, ''), '{_W}', '', 'g'), '−', '-')), 'ß', 'ss')"


def query(oracle: str | None, name: str | None = None):
    """Registers a query with its SQL. Whole numbers are returned as bigint."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c) for c, k in df.dtypes))

        _QUERIES[name or f.__name__] = run
        if oracle:
            _ORACLE[name or f.__name__] = oracle
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["quality_summary"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quirelake.plans import recipes, rules  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quirelake.plans import recipes, rules  # noqa: F401

    return dict(_ORACLE)


def _with_box(df: DataFrame) -> DataFrame:
    return df.withColumn("bbox", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).drop("x0", "y0", "x1", "y1")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + LINES.format(lineitem=f"parquet.`{d}/lineitem.parquet`"))


# ---- text --------------------------------------------------------------------------------------


@query(f"{cte('marked')} SELECT doc_id, md5({_compact('text')}) AS h, length({_compact('text')}) AS n FROM marked")
def compact_text(spark, d):
    c = T.compact_text(F.col("text"))
    return source(spark, d, "marked").select("doc_id", F.md5(c).alias("h"), F.char_length(c).alias("n"))


@query(f"{cte('marked')} SELECT doc_id, md5({_norm('text')}) AS h FROM marked")
def normalized(spark, d):
    return source(spark, d, "marked").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("h"))


@query(rf"{cte('marked')} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([-−]?\(?\d[\d,]*(?:\.\d+)?%?\)?)', 1), lambda n: replace(regexp_replace(n, '[\s,]', '', 'g'), '−', '-')), ' ') AS tokens FROM marked")
def number_tokens(spark, d):
    return source(spark, d, "marked").select("doc_id", F.array_join(T.number_tokens(F.col("text")), " ").alias("tokens"))


@query(rf"{cte('marked')} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d{{4}}\s*年\s*\d{{1,2}}\s*月\s*\d{{1,2}}\s*日'), lambda x: regexp_replace(x, '\s+', '', 'g')))), ' ') AS dates FROM marked")
def date_tokens(spark, d):
    return source(spark, d, "marked").select("doc_id", F.array_join(T.date_tokens(F.col("text")), " ").alias("dates"))


@query(f"{cte('pages_q')} SELECT content_id, coalesce(regexp_matches(content, '(?:[犀-狿][ \\t]*){{6,}}'), false) AS bad FROM pages_q")
def mojibake(spark, d):
    return source(spark, d, "pages_q").select("content_id", T.mojibake(F.col("content")).alias("bad"))


@query(f"{cte('pages_q')} SELECT content_id, CASE WHEN length(content) > 0 THEN (length(content) - length(replace(content, '�', '')))::DOUBLE / length(content) END AS ratio FROM pages_q")
def replacement_ratio(spark, d):
    return source(spark, d, "pages_q").select("content_id", T.replacement_ratio(F.col("content")).alias("ratio"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(html, '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM pages")
def md_normalize(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.markdown_normalized(F.col("html"))).alias("h"))


@query("SELECT page_id, md5(replace(replace(replace(replace(trim(replace(html, chr(10), ' ')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '&#124;')) AS h FROM pages")
def gfm_escape(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.gfm_cell(F.col("html"))).alias("h"))


@query(f"{cte('pages_q')}, l AS (SELECT content_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM pages_q) SELECT content_id, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT starts_with(ltrim(l), '|') AND NOT starts_with(trim(l), '<!--')), '')) AS h FROM l GROUP BY content_id")
def plain_lines(spark, d):
    return source(spark, d, "pages_q").where("content IS NOT NULL").select("content_id", F.md5(T.plain_lines(F.col("content"))).alias("h"))


_SIZE = "CASE WHEN doc_id % 50 = 0 THEN NULL ELSE n_chars * (doc_id % 7) * (doc_id % 11) * 997 END"


@query(rf"""WITH s AS (SELECT doc_id, {_SIZE} AS n FROM documents), u AS (SELECT *, CASE WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END AS u FROM s),
r AS (SELECT *, floor(n::HUGEINT * 100 / u + 0.5)::BIGINT AS c, floor(n::HUGEINT * 10 / u + 0.5)::BIGINT AS t FROM u)
SELECT doc_id, CASE WHEN n IS NULL THEN '—' WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN n < 10 * u THEN (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') ELSE (t // 10) || '.' || (t % 10) END || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size FROM r""")
def bytes_format(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.bytes_format(F.expr(_SIZE)).alias("size"))


@query(r"SELECT doc_id, least(100e0, greatest(0e0, CASE WHEN doc_id % 4 = 0 THEN doc_id - 50e0 WHEN doc_id % 7 = 0 THEN 0e0 ELSE n_chars / (doc_id % 7)::DOUBLE * 100 END)) AS percent, trim(regexp_replace(source || ' ' || doc_id, '[^\p{L}\p{N}._-]+', '-', 'g'), '-') || '.md' AS name FROM documents")
def percent_and_name(spark, d):
    supplied = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") - 50.0)
    name = F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".old"))
    return _docs(spark, d).select("doc_id", T.percent_of(F.col("n_chars"), F.col("doc_id") % 7, supplied).alias("percent"), T.download_name(name, "md").alias("name"))


@query(f"""{cte('marked')}, c AS (SELECT doc_id, string_split(text, ' ') AS cells FROM marked) SELECT doc_id, array_to_string(list_transform(cells, lambda c: replace(lower(regexp_replace(c, '{_W}', '', 'g')), 'ß', 'ss')), '|') AS sig FROM c""")
def header_signature(spark, d):
    return source(spark, d, "marked").select("doc_id", T.header_signature(F.split("text", " ")).alias("sig"))


@query("SELECT doc_id, (length(text) - length(replace(text, ' ', ''))) >= 20 AND (length(text) - length(replace(text, ' ', '')))::DOUBLE / greatest(length(replace(text, ' ', '')), 1) >= 0.08 AS polluted FROM documents")
def spacing_pollution(spark, d):
    gone = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    seen = F.greatest(F.char_length(F.replace("text", F.lit(" "), F.lit(""))), F.lit(1))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ((gone >= 20) & (gone / seen >= 0.08)).alias("polluted"))


# ---- units and routing -------------------------------------------------------------------------


@query(rf"""{cte('uploads')}, i AS (SELECT doc_id AS id, units + 1 AS total, value, CASE WHEN value IS NULL THEN NULL ELSE list_transform(string_split(value, ','), lambda x: trim(x)) END AS items FROM uploads),
b AS (SELECT *, list_transform(items, lambda x: regexp_extract(x, '^[0-9]+')) AS lo, list_transform(items, lambda x: regexp_extract(x, '[0-9]+$')) AS hi FROM i),
e AS (SELECT id, total, lo, hi, CASE WHEN value IS NULL THEN NULL WHEN list_contains(items, '') THEN 'empty_item' WHEN list_bool_or(list_transform(range(1, len(items) + 1), lambda k: lo[k]::BIGINT > hi[k]::BIGINT)) THEN 'reversed'
  WHEN list_bool_or(list_transform(hi, lambda x: x::BIGINT > total)) THEN 'beyond_total' END AS error FROM b)
SELECT id, NULL::BIGINT AS unit, error FROM e WHERE error IS NOT NULL
UNION ALL SELECT id, unnest(range(1, total + 1)) AS unit, NULL FROM e WHERE lo IS NULL
UNION ALL SELECT DISTINCT id, unnest(flatten(list_transform(range(1, len(lo) + 1), lambda k: range(lo[k]::BIGINT, hi[k]::BIGINT + 1)))) AS unit, NULL FROM e WHERE error IS NULL AND lo IS NOT NULL""")
def unit_range_expand(spark, d):
    return units.unit_range_expand(source(spark, d, "uploads").selectExpr("doc_id id", "value", "units + 1 as total"))


_RUNS = f"""{cte('units')}, u AS (SELECT DISTINCT content_id, unit FROM units), r AS (SELECT content_id, unit, unit - row_number() OVER (PARTITION BY content_id ORDER BY unit) AS run FROM u), g AS (SELECT content_id, min(unit) AS first, max(unit) AS last FROM r GROUP BY content_id, run)"""


@query(f"{_RUNS} SELECT content_id, string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ',' ORDER BY first) AS units FROM g GROUP BY content_id")
def unit_range_format(spark, d):
    return units.unit_range_format(source(spark, d, "units"), "content_id", "unit")


@query(f"{_RUNS} SELECT content_id, first, last FROM g")
def consecutive_groups(spark, d):
    return units.consecutive_groups(source(spark, d, "units"), "content_id", "unit")


@query(rf"""{cte('uploads')}, s AS (SELECT doc_id, units, value, list_transform(string_split(value, ','), lambda x: trim(x)) AS items FROM uploads)
SELECT doc_id, coalesce(list_bool_and(list_transform(items, lambda x: regexp_matches(x, '^[1-9][0-9]*(\s*-\s*[1-9][0-9]*)?$'))) AND list_bool_or(list_transform(items, lambda x: coalesce(try_cast(regexp_extract(x, '^[0-9]+') AS BIGINT) <= units AND try_cast(regexp_extract(x, '[0-9]+$') AS BIGINT) >= units, false))), false) AS inside FROM s""")
def unit_range_contains(spark, d):
    rows = source(spark, d, "uploads")
    items = F.transform(F.split("value", ","), lambda x: F.trim(x))
    ok = F.forall(items, lambda x: x.rlike(r"^[1-9][0-9]*(\s*-\s*[1-9][0-9]*)?$"))
    return rows.select("doc_id", F.coalesce(F.when(ok, units.unit_range_contains(F.col("value"), F.col("units"))), F.lit(False)).alias("inside"))


@query(f"{cte('units')}, n AS (SELECT content_id, unnest([unit - 1, unit, unit + 1]) AS unit, total FROM units) SELECT DISTINCT content_id, unit FROM n WHERE unit BETWEEN 1 AND total")
def nearby_pages(spark, d):
    return units.nearby_units(source(spark, d, "units"), "content_id", "unit", "total")


@query(f"""{cte('evidence')} SELECT doc_id, CASE WHEN chars < 40 AND cover < 0.05 AND coalesce(ink < 0.015, false) THEN 'sparse' WHEN chars >= 40 AND cover < 0.2 THEN 'native' WHEN chars < 40 AND (cover >= 0.8 OR coalesce(ink >= 0.03, false)) THEN 'scanned' ELSE 'mixed' END AS kind FROM evidence""")
def page_source_kind(spark, d):
    return source(spark, d, "evidence").select("doc_id", units.page_source_kind(F.col("chars"), F.col("cover"), F.col("ink")).alias("kind"))


@query(f"""{cte('evidence')} SELECT doc_id, CASE WHEN failed THEN CASE WHEN chars >= 80 OR (chars >= 40 AND coalesce(ink, 0) >= 0.02 AND cover >= 0.55) THEN 'document' WHEN chars >= 15 THEN 'mixed' WHEN cover >= 0.4 OR coalesce(ink, 0) < 0.08 THEN 'visual' ELSE 'unknown' END
  ELSE CASE WHEN chars >= 80 THEN 'document' WHEN chars >= 15 THEN 'mixed' WHEN chars = 0 THEN 'visual' ELSE 'unknown' END END AS class FROM evidence""")
def image_class(spark, d):
    return source(spark, d, "evidence").select("doc_id", units.image_class(F.col("chars"), F.col("cover"), F.col("ink"), F.col("failed")).alias("class"))


@query(f"""{cte('evidence')} SELECT doc_id, CASE WHEN ink >= 0.02 THEN CASE WHEN (h >= 3 AND v >= 3 AND grid_area >= 0.25) OR (failed AND regions > 0) THEN 'table' WHEN hint AND (placeholder OR cover >= 0.2 OR repeated) THEN 'signature' END END AS target FROM evidence""")
def visual_targets(spark, d):
    c = F.col
    kind = F.when(c("ink") >= 0.02, "scanned").otherwise("native")
    return source(spark, d, "evidence").select("doc_id", units.visual_target(kind, c("h"), c("v"), c("grid_area"), c("failed"), c("regions"), c("hint"), c("placeholder"), c("cover"), c("repeated")).alias("target"))


@query(f"{cte('evidence')} SELECT doc_id, h >= 3 AND v >= 3 AS complex FROM evidence")
def complex_grid(spark, d):
    return source(spark, d, "evidence").select("doc_id", units.complex_grid(F.col("h"), F.col("v")).alias("complex"))


@query(f"{cte('evidence')} SELECT doc_id, coalesce(CASE WHEN v >= 3 AND v > 1.35 * h AND grid_h > 1.1 * grid_w THEN 90 WHEN width > 1.1 * height THEN 0 WHEN h >= 3 AND h > 1.35 * v THEN 0 END, rotation)::BIGINT AS degrees FROM evidence")
def rotation_guess(spark, d):
    c = F.col
    return source(spark, d, "evidence").select("doc_id", units.rotation_guess(c("h"), c("v"), c("grid_w"), c("grid_h"), c("width"), c("height"), c("rotation")).alias("degrees"))


@query(f"{cte('uploads')} SELECT doc_id, CASE WHEN mode = 'async' OR starts_with(mime, 'video/') OR size > 20971520 OR units > 10 THEN 'async' ELSE 'sync' END AS route FROM uploads")
def sync_async_route(spark, d):
    c = F.col
    return source(spark, d, "uploads").select("doc_id", units.route(c("mode"), c("mime"), c("size"), c("units")).alias("route"))


@query(f"{cte('uploads')} SELECT doc_id, CASE WHEN starts_with(mime, 'video/') AND value IS NOT NULL THEN 'invalid_unit_range' WHEN (contains(mime, 'wordprocessingml') OR (starts_with(mime, 'image/') AND mime <> 'image/tiff')) AND value <> '1' THEN 'invalid_unit_range' END AS error FROM uploads")
def selection_valid(spark, d):
    return source(spark, d, "uploads").select("doc_id", units.selection_error(F.col("mime"), F.col("value")).alias("error"))


@query(f"{cte('uploads')} SELECT doc_id, CASE WHEN contains(mime, 'presentationml') THEN 'slide' WHEN starts_with(mime, 'video/') THEN 'frame' WHEN mime IN ('application/pdf', 'image/tiff') THEN 'page' ELSE 'asset' END AS unit FROM uploads")
def progress_unit(spark, d):
    return source(spark, d, "uploads").select("doc_id", units.progress_unit(F.col("mime")).alias("unit"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'qwen' WHEN doc_id % 4 = 1 THEN 'glm' WHEN doc_id % 4 = 2 THEN 'native' ELSE 'docling' END AS kind FROM documents")
def source_kind_norm(spark, d):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'My-VLM' WHEN 1 THEN 'sdk_remote' WHEN 2 THEN 'PyMuPDF text' ELSE 'other' END")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", units.source_kind_norm(name).alias("kind"))


# ---- quality -----------------------------------------------------------------------------------

_FRAGMENTS = rf"""l AS (SELECT content_id, page_number, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM pages_q),
prose AS (SELECT content_id, page_number, regexp_replace(string_agg(l, chr(10) ORDER BY i), '(?i)https?://[^\s|）)]+', '', 'g') AS p FROM l WHERE NOT starts_with(ltrim(l), '|') AND NOT starts_with(trim(l), '<!--') GROUP BY ALL),
f AS (SELECT content_id, page_number, regexp_replace(unnest(regexp_split_to_array(p, '[\n。！？.!?]+')), '^\s+|\s+$', '', 'g') AS f FROM prose),
rep AS (SELECT content_id, page_number, max(n)::BIGINT AS repeat_count FROM (SELECT content_id, page_number, f, count(*) AS n FROM f WHERE length(f) BETWEEN 4 AND 120 AND NOT regexp_matches(f, '(?i)(?:https?://|www\.)') GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL)"""


@query(f"{cte('pages_q')}, {_FRAGMENTS} SELECT content_id, page_number, repeat_count FROM rep")
def repeat_fragments(spark, d):
    return quality.repeat_fragments(source(spark, d, "pages_q"), ["content_id", "page_number"])


_NUMBERS = r"list_transform(regexp_extract_all({}, '(?:^|[^A-Za-z0-9])([-−]?\(?\d[\d,]*(?:\.\d+)?%?\)?)', 1), lambda n: replace(regexp_replace(n, '[\s,]', '', 'g'), '−', '-'))"
_CODES = rf"""{_FRAGMENTS}, b AS (SELECT * REPLACE (regexp_replace(content, '^{_W}+|{_W}+$', '', 'g') AS content) FROM pages_q),
k AS (SELECT b.*, repeat_count, status <> 'failed' AS live, list_filter(string_split(content, chr(10)), lambda l: starts_with(trim(l), '|') AND length(l) - length(replace(l, '|', '')) >= 2) AS rows,
  list_filter(string_split(content, chr(10)), lambda l: NOT starts_with(trim(l), '|') AND regexp_full_match(trim(l), '[-−]?\(?\d[\d,]*(?:\.\d+)%?\)?')) AS loose,
  content = '|1|2|3|4|5|6|7|8|9|a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|q|' AS wide, content = '| same | same | same | same | same | x |' AS same FROM b LEFT JOIN rep USING (content_id, page_number)),
c AS (SELECT *, list_sort(list_filter([
  CASE WHEN content = '' AND live THEN 'no_usable_content' END,
  CASE WHEN source_kind = 'sparse' AND content <> '' AND live THEN 'intentional_sparse_page' END,
  CASE WHEN source_kind <> 'sparse' AND content <> '' AND live AND length(content) < 12 THEN 'low_text_content' END,
  CASE WHEN live AND content <> '' AND (length(content) - length(replace(content, '�', '')))::DOUBLE / length(content) > 0.02 THEN 'high_replacement_character_ratio' END,
  CASE WHEN live AND repeat_count IS NOT NULL THEN 'repeated_text' END,
  CASE WHEN live AND same THEN 'table_header_propagation' END,
  CASE WHEN live AND wide THEN 'table_shape_explosion' END,
  CASE WHEN content <> '' AND live AND rotation IN (90, 180, 270) THEN 'rotated_scan' END,
  CASE WHEN content <> '' AND live AND source_kind = 'native' AND strategy = 'docling' AND native_chars > 0 AND length(regexp_replace(content, '{_W}', '', 'g')) < native_chars * 0.2 THEN 'visual_text_mismatch' END,
  CASE WHEN live AND len(rows) > 0 AND len(list_intersect({_NUMBERS.format("array_to_string(rows, chr(10))")}, {_NUMBERS.format("array_to_string(loose, chr(10))")})) > 0 THEN 'unanchored_table_numbers' END,
  CASE WHEN live AND regexp_matches(replace(replace(content, chr(10), ''), chr(9), ''), '[\p{{Cc}}\p{{Cf}}\p{{Co}}\x{{FFFD}}]') THEN 'suspicious_unicode_glyphs' END,
  CASE WHEN live AND regexp_matches(content, '(?:[犀-狿][ \t]*){{6,}}') THEN 'suspicious_unicode_mojibake' END], lambda x: x IS NOT NULL)) AS codes FROM k),
s AS (SELECT *, CASE WHEN status = 'failed' OR list_contains(codes, 'no_usable_content') THEN 'failed' WHEN len(list_filter(codes, lambda x: x NOT IN ('intentional_sparse_page', 'rotated_scan'))) > 0 THEN 'warning' ELSE status END AS st FROM c),
v AS (SELECT *, CASE WHEN NOT measured THEN CASE WHEN st IN ('warning', 'failed') THEN 'untrusted' ELSE 'trusted' END WHEN fused THEN CASE WHEN st = 'failed' THEN 'untrusted' WHEN coalesce(conflicts, 0) > 0 OR st = 'warning' THEN 'degraded' ELSE 'trusted' END ELSE CASE WHEN st IN ('warning', 'failed') THEN 'untrusted' ELSE 'trusted' END END AS verdict FROM s)"""


@query(f"{cte('pages_q')}, {_CODES} SELECT content_id, page_number, array_to_string(codes, ',') AS codes FROM v")
def page_quality_codes(spark, d):
    rows = quality.page_codes(source(spark, d, "pages_q"), ["content_id", "page_number"])
    return rows.select("content_id", "page_number", F.array_join("codes", ",").alias("codes"))


@query(f"{cte('pages_q')}, {_CODES} SELECT content_id, page_number, st AS status, verdict FROM v")
def page_verdicts(spark, d):
    return quality.assess(quality.page_codes(source(spark, d, "pages_q"), ["content_id", "page_number"])).select("content_id", "page_number", "status", "verdict")


@query(f"{cte('pages_q')}, {_CODES} SELECT content_id % 100 AS content_id, count(*) FILTER (verdict = 'trusted') AS trusted_pages, count(*) FILTER (verdict = 'degraded') AS degraded_pages, count(*) FILTER (verdict = 'untrusted') AS untrusted_pages, count(*) FILTER (st = 'failed') AS failed_pages, bool_and(st <> 'failed' AND len(list_filter(codes, lambda x: x NOT IN ('intentional_sparse_page', 'rotated_scan'))) = 0) AS acceptable, count(*) FILTER (measured AND strategy <> 'docling') AS repaired_pages, count(*) FILTER (measured AND fused) AS visual_pages, coalesce(sum(calls) FILTER (measured AND fused), 0)::BIGINT AS calls, coalesce(sum(resolved) FILTER (measured AND fused), 0)::BIGINT AS resolved_conflicts, coalesce(sum(conflicts) FILTER (measured AND fused), 0)::BIGINT AS unresolved_conflicts FROM v GROUP BY ALL")
def quality_summary(spark, d):
    pages = quality.assess(quality.page_codes(source(spark, d, "pages_q"), ["content_id", "page_number"]))
    return quality.quality_summary(pages.withColumn("content_id", F.col("content_id") % 100), "content_id")


@query(f"""{cte('pairs')}, r AS (SELECT doc_id, unnest(string_split({_compact('reference')}, '')) AS ch, 0 AS side FROM pairs UNION ALL SELECT doc_id, unnest(string_split({_compact('candidate')}, '')), 1 FROM pairs),
n AS (SELECT doc_id, ch, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM r WHERE ch <> '' GROUP BY ALL)
SELECT doc_id, sum(least(a, b))::DOUBLE / sum(a) AS coverage FROM n GROUP BY doc_id""")
def char_multiset_coverage(spark, d):
    return quality.char_multiset_coverage(source(spark, d, "pairs"), "doc_id", "reference", "candidate")


@query("WITH t AS (SELECT l_orderkey AS k, l_partkey % 50 AS tok, l_linenumber % 2 AS side FROM lineitem), n AS (SELECT k, tok, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY ALL) SELECT k, sum(least(a, b))::BIGINT AS shared FROM n GROUP BY k")
def multiset_intersect(spark, d):
    return quality.multiset_intersect(spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey k", "l_partkey % 50 tok", "l_linenumber % 2 side"), "k", "tok", "side")


@query("""WITH k AS (SELECT doc_id, lang AS code FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id, lang AS code FROM documents UNION ALL SELECT doc_id, source FROM documents)
SELECT doc_id, code FROM k UNION ALL SELECT doc_id, code FROM f ANTI JOIN k USING (doc_id, code)""")
def warning_union(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = docs.selectExpr("doc_id", "lang code").union(docs.selectExpr("doc_id", "source code"))
    return quality.warning_union(docs.where("doc_id % 2 = 0").selectExpr("doc_id", "lang code"), found, ["doc_id", "code"])


@query("""WITH e AS (SELECT doc_id, ['w' || (doc_id % 3), 'w' || (doc_id % 4)] AS req, ['w' || (doc_id % 5)] AS ok FROM documents), a AS (SELECT doc_id, ['w' || (quality % 3), 'w' || toxic] AS have FROM labels)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(req, lambda x: NOT list_contains(coalesce(have, []), x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(coalesce(have, []), lambda x: NOT list_contains(ok, x) AND NOT list_contains(req, x)))), ',') AS unexpected FROM e LEFT JOIN a USING (doc_id)""")
def manifest_check(spark, d):
    e = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "array(concat('w', doc_id % 3), concat('w', doc_id % 4)) required", "array(concat('w', doc_id % 5)) allowed")
    a = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "array(concat('w', quality % 3), concat('w', toxic)) codes")
    return quality.manifest_check(e, a, ["doc_id"]).selectExpr("doc_id", "array_join(missing, ',') missing", "array_join(unexpected, ',') unexpected")


# ---- layout ------------------------------------------------------------------------------------

_OVER = "greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0)"


@query(f"{cte('blocks', 'tables')} SELECT content_id, page_number, ord FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.content_id = b.content_id AND t.page_number = b.page_number AND {_OVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5)")
def block_not_in_table(spark, d):
    return layout.block_not_in_table(_with_box(source(spark, d, "blocks")), _with_box(source(spark, d, "tables"))).select("content_id", "page_number", "ord")


@query(f"{cte('blocks', 'tables')} SELECT content_id, page_number, ord FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.content_id = b.content_id AND t.page_number = b.page_number AND {_OVER} / greatest((b.x1 - b.x0) * (b.y1 - b.y0), 0.01) >= 0.25)")
def native_outside_tables(spark, d):
    return layout.block_not_in_table(_with_box(source(spark, d, "blocks")), _with_box(source(spark, d, "tables")), 0.25, 0.01).select("content_id", "page_number", "ord")


@query(f"""{cte('blocks')} SELECT content_id, page_number, text, count(*) AS n FROM blocks b WHERE EXISTS (SELECT 1 FROM blocks t WHERE t.content_id = b.content_id AND t.page_number = b.page_number AND t.text = b.text AND t.ord < b.ord
  AND {_OVER} / ((b.x1 - b.x0) * (b.y1 - b.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_OVER}) >= 0.8) GROUP BY ALL""")
def iou_duplicates(spark, d):
    return layout.iou_duplicates(_with_box(source(spark, d, "blocks")))


@query(f"""{cte('blocks')}, e AS (SELECT *, y1 <= 0.05 OR y0 >= 0.95 AS edge FROM blocks), n AS (SELECT DISTINCT content_id, unnest([page_number - 1, page_number + 1]) AS page_number, text FROM e WHERE edge)
SELECT content_id, page_number, ord FROM e WHERE NOT (edge AND EXISTS (SELECT 1 FROM n WHERE n.content_id = e.content_id AND n.page_number = e.page_number AND n.text = e.text))""")
def margin_repeat(spark, d):
    return layout.margin_repeat(_with_box(source(spark, d, "blocks"))).select("content_id", "page_number", "ord")


@query(f"{cte('blocks')}, m AS (SELECT content_id, page_number, median(size) AS m FROM blocks WHERE size > 0 GROUP BY ALL) SELECT content_id, page_number, ord, m AS median_size, m > 0 AND (bold OR size >= 1.28 * m) AS heading FROM blocks JOIN m USING (content_id, page_number)")
def heading_flag(spark, d):
    return layout.heading_flag(_with_box(source(spark, d, "blocks"))).select("content_id", "page_number", "ord", "median_size", "heading")


@query(f"{cte('blocks')} SELECT content_id, page_number, ord, row_number() OVER (PARTITION BY content_id, page_number ORDER BY CASE WHEN ord % 7 = 0 THEN 2 ELSE y0 END, CASE WHEN ord % 7 = 0 THEN 2 ELSE x0 END, ord) AS reading_order FROM blocks")
def region_order(spark, d):
    rows = _with_box(source(spark, d, "blocks")).withColumn("bbox", F.when(F.col("ord") % 7 != 0, F.col("bbox")))
    return layout.region_order(rows).select("content_id", "page_number", "ord", "reading_order")


@query(f"""{cte('blocks')}, n AS (SELECT *, x1 - x0 <= 0.68 * 1.0 AS narrow, (x0 + x1) / 2 AS center FROM blocks),
g AS (SELECT *, row_number() OVER w AS i, lead(center) OVER w - center AS gap FROM n WINDOW w AS (PARTITION BY content_id, page_number, narrow ORDER BY center, y0, x0, ord)),
p AS (SELECT content_id, page_number, count(*) FILTER (narrow) AS n, max(struct_pack(gap := gap, i := i)) FILTER (narrow AND gap IS NOT NULL) AS best, min(y0) FILTER (narrow) AS top, max(y1) FILTER (narrow) AS bottom FROM g GROUP BY ALL),
z AS (SELECT g.*, p.n, p.best, CASE WHEN narrow THEN CASE WHEN i <= best.i THEN 1 ELSE 2 END WHEN y1 <= p.top THEN 0 WHEN y0 >= p.bottom THEN 3 END AS zone FROM g JOIN p USING (content_id, page_number)),
q AS (SELECT *, coalesce(n >= 4 AND best.gap >= 0.18 * 1.0 AND best.i >= 2 AND n - best.i >= 2 AND count(*) FILTER (zone IS NULL) OVER (PARTITION BY content_id, page_number) = 0, false) AS clear FROM z)
SELECT content_id, page_number, ord, row_number() OVER (PARTITION BY content_id, page_number ORDER BY CASE WHEN clear THEN zone ELSE 0 END, y0, x0, ord) AS reading_order FROM q""")
def reading_order(spark, d):
    return layout.reading_order(_with_box(source(spark, d, "blocks")).withColumn("page_width", F.lit(1.0))).select("content_id", "page_number", "ord", "reading_order")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -i ELSE i END AS o, CMP_T AS a FROM l), u AS (SELECT * FROM a WHERE length(a) >= 8 QUALIFY count(*) OVER (PARTITION BY doc_id, a) = 1),
h AS (SELECT u.doc_id, o, instr(CMP_B, a) AS pos FROM u JOIN documents USING (doc_id) WHERE length(CMP_B) - length(replace(CMP_B, a, '')) = length(a)),
b AS (SELECT doc_id, pos < lag(pos) OVER (PARTITION BY doc_id ORDER BY o) AS back FROM h) SELECT doc_id AS content_id, count(*) >= 4 AND coalesce(bool_or(back), false) AS inverted FROM b GROUP BY doc_id""".replace("CMP_T", _compact("t")).replace("CMP_B", _compact("text")))
def order_inversion(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id content_id", "1 page_number", "text content")
    anchors = docs.select("content_id", "page_number", F.posexplode(T.lines(F.col("content"))).alias("i", "text")).selectExpr("content_id", "page_number", "if(content_id % 3 = 0, -i, i) ord", "text")
    return layout.order_inversion(anchors, docs).select("content_id", "inverted")


# ---- tables ------------------------------------------------------------------------------------


_LINKED = f"""{cte('fragments')}, e AS (SELECT content_id, page_number, arg_max(f, ordinal) AS l, arg_min(f, ordinal) AS r, count(*) AS n FROM (SELECT content_id, page_number, ordinal, f FROM fragments f) GROUP BY ALL),
p AS (SELECT a.content_id, a.page_number, a.l, b.r, b.n = 1 AS single FROM e a JOIN e b ON a.content_id = b.content_id AND b.page_number = a.page_number + 1
  WHERE a.l.valid AND b.r.valid AND a.l.bottom >= 0.85 AND b.r.top <= 0.15 AND (abs(a.l.b1 - b.r.b1) + abs(a.l.b2 - b.r.b2)) / 2 <= 0.02
    AND CASE WHEN b.r.has_header THEN a.l.header <> '' AND b.r.header <> '' AND (a.l.header = b.r.header OR starts_with(a.l.header, 'total|') AND starts_with(b.r.header, 'total|')) ELSE b.r.n_rows > 0 END),
c AS (SELECT *, CASE WHEN coalesce(lag(page_number) OVER w = page_number - 1 AND lag(single) OVER w, false) THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY content_id ORDER BY page_number)),
k AS (SELECT *, sum(s) OVER (PARTITION BY content_id ORDER BY page_number) AS chain FROM c),
linked AS (SELECT content_id, page_number, l, r FROM (SELECT *, row_number() OVER (PARTITION BY content_id, chain ORDER BY page_number) AS i FROM k) WHERE i % 2 = 1)"""


@query(f"{_LINKED} SELECT content_id, l.fragment_id AS left_id, r.fragment_id AS right_id FROM linked")
def cross_page_link(spark, d):
    return tables.cross_page_link(source(spark, d, "fragments").withColumn("boundaries", F.array("b1", "b2")))


@query(f"{cte('fragments')} SELECT content_id, page_number, max(fragment_id) AS tail_id, min(fragment_id) AS head_id FROM fragments GROUP BY ALL")
def fragment_tail_head(spark, d):
    return tables.fragment_ends(source(spark, d, "fragments")).selectExpr("content_id", "page_number", "tail.fragment_id tail_id", "head.fragment_id head_id")


_GRID = "SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, l_partkey % 3 AS c, CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 1 END AS row_span, CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS col_span FROM {lineitem}"


@query(f"WITH g AS ({_GRID.format(lineitem='lineitem')}) SELECT table_id, r::BIGINT AS r, c, r = 0 AS header FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.table_id = a.table_id AND (a.r <> b.r OR a.c <> b.c) AND a.r BETWEEN b.r AND b.r + b.row_span - 1 AND a.c BETWEEN b.c AND b.c + b.col_span - 1)")
def cell_spans(spark, d):
    return tables.cell_spans(spark.sql(_GRID.format(lineitem=f"parquet.`{d}/lineitem.parquet`")), ["table_id"]).select("table_id", "r", "c", "header")


@query(f"WITH g AS ({_GRID.format(lineitem='lineitem')}), p AS (SELECT table_id, r, c, unnest(range(r, r + row_span)) AS rr, col_span FROM g), q AS (SELECT table_id, rr, unnest(range(c, c + col_span)) AS cc FROM p), n AS (SELECT table_id, rr, cc, count(*) AS n FROM q GROUP BY ALL) SELECT table_id, max(n) > 1 AS overlapping FROM n GROUP BY table_id")
def overlapping_cells(spark, d):
    return tables.overlapping_cells(spark.sql(_GRID.format(lineitem=f"parquet.`{d}/lineitem.parquet`")), ["table_id"])


@query("WITH lines AS " + LINES.format(lineitem="lineitem") + """, r AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS i, CASE WHEN l_linenumber % 3 = 0 THEN ['a<' || l_partkey] ELSE ['p|' || l_partkey, 'R & ' || l_suppkey] END AS cells FROM lines),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY table_id) AS w FROM r),
t AS (SELECT table_id, i, w, '| ' || array_to_string(list_concat(list_transform(cells, lambda c: replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '&#124;')), CASE WHEN len(cells) < w THEN [''] ELSE [] END), ' | ') || ' |' AS t FROM w)
SELECT table_id, string_agg(CASE WHEN i = 0 THEN t || chr(10) || '| ' || repeat('--- | ', (w - 1)::INT) || '--- |' ELSE t END, chr(10) ORDER BY i) AS markdown FROM t GROUP BY table_id""")
def gfm_render(spark, d):
    rows = _lines(spark, d).selectExpr("l_orderkey table_id", "l_linenumber - 1 row_index", "if(l_linenumber % 3 = 0, array(concat('a<', l_partkey)), array(concat('p|', l_partkey), concat('R & ', l_suppkey))) cells")
    return tables.gfm_render(rows, ["table_id"])


_LINES = "SELECT l_orderkey AS doc, l_linenumber AS i, CASE WHEN l_partkey % 4 = 0 THEN 'prose' WHEN l_partkey % 4 = 1 THEN '| --- | --- |' WHEN l_partkey % 4 = 2 THEN '| a | b | c |' ELSE '| x | y |' END AS t FROM {lineitem}"


@query(rf"""WITH l AS ({_LINES.format(lineitem='lineitem')}), p AS (SELECT *, sum(CASE WHEN starts_with(t, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS run FROM l),
c AS (SELECT doc, run, len(string_split(regexp_replace(t, '^\||\|$', '', 'g'), '|')) AS n FROM p WHERE starts_with(t, '|') AND NOT contains(t, '---')) SELECT doc, count(*) - 1 AS n_rows, max(n)::BIGINT AS n_cols FROM c GROUP BY doc, run""")
def table_shape(spark, d):
    return tables.table_shapes(spark.sql(_LINES.format(lineitem=f"parquet.`{d}/lineitem.parquet`")), ["doc"], "i", "t")


_EDGES = "SELECT l_orderkey AS table_id, l_linenumber - 1 AS column_index, 7 AS num_cols, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (l_partkey % 64) / 64e0 END AS left_edge FROM {lineitem}"


@query(f"WITH e AS ({_EDGES.format(lineitem='lineitem')}) SELECT table_id, column_index::BIGINT AS column_index, coalesce(avg(left_edge), column_index / 7e0) AS boundary FROM e GROUP BY table_id, column_index")
def column_boundaries(spark, d):
    return tables.column_boundaries(spark.sql(_EDGES.format(lineitem=f"parquet.`{d}/lineitem.parquet`")), ["table_id"], "num_cols").select("table_id", "column_index", "boundary")


@query("""WITH t AS (SELECT o_orderkey AS id, list_transform(range(0, 4 + o_orderkey % 7), lambda k: 'c' || k) AS c, o_orderkey % 3 = 0 AS hint FROM orders), s AS (SELECT *, len(c) >= 8 AND len(c) % 2 = 0 AND hint AS split FROM t)
SELECT id AS table_id, 'single' AS side, array_to_string(c, ',') AS columns FROM s WHERE NOT split UNION ALL SELECT id, 'left', array_to_string(c[1:len(c) // 2], ',') FROM s WHERE split UNION ALL SELECT id, 'right', array_to_string(c[len(c) // 2 + 1:], ',') FROM s WHERE split""")
def parallel_split(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey table_id", "transform(sequence(0, cast(3 + o_orderkey % 7 as int)), k -> concat('c', k)) columns", "o_orderkey % 3 = 0 hint")
    return tables.parallel_split(t).select("table_id", "side", F.array_join("columns", ",").alias("columns"))


@query("WITH lines AS " + LINES.format(lineitem="lineitem") + """, r AS (SELECT l_orderkey AS f, l_linenumber - 1 AS i, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'Headline' WHEN l_orderkey % 3 = 1 THEN 'head lines ' ELSE 'other' END ELSE l_partkey::VARCHAR END AS cell FROM lines),
p AS (SELECT f AS a, f + 1 AS b FROM r WHERE i = 0 AND f % 2 = 0 AND f + 1 IN (SELECT f FROM r WHERE i = 0)),
u AS (SELECT a, 0 AS part, i, cell FROM p JOIN r ON f = a UNION ALL SELECT a, 1, i, cell FROM p JOIN r ON f = b WHERE i > 0 OR b % 5 = 0 OR a % 3 = 2 OR b % 3 = 2)
SELECT a AS left_id, row_number() OVER (PARTITION BY a ORDER BY part, i) - 1 AS row_index, cell FROM u""")
def merged_rows(spark, d):
    name = "case l_orderkey % 3 when 0 then 'Headline' when 1 then 'head lines ' else 'other' end"
    rows = _lines(spark, d).selectExpr("l_orderkey fragment_id", "l_linenumber - 1 row_index", f"array(case when l_linenumber = 1 then {name} else cast(l_partkey as string) end) cells", "l_orderkey % 5 <> 0 has_header")
    heads = rows.where("row_index = 0").select("fragment_id")
    pairs = heads.where("fragment_id % 2 = 0").selectExpr("fragment_id left_id", "fragment_id + 1 right_id").join(heads.withColumnRenamed("fragment_id", "right_id"), "right_id", "left_semi")
    return tables.merged_rows(pairs, rows).selectExpr("left_id", "row_index", "cells[0] cell")


_PAGES = """SELECT content_id, page_number, concat(CASE WHEN page_number % 5 = 0 THEN '# Part' ELSE 'text' END, chr(10), {listed}, chr(10), CASE WHEN content_id % 7 = 0 THEN '2.1 Next' ELSE 'more' END) AS content FROM {fragments} GROUP BY content_id, page_number"""


@query(f"""{_LINKED}, pages_f AS ({_PAGES.format(listed="string_agg(rendered, chr(10) ORDER BY ordinal)", fragments="fragments")}),
ok AS (SELECT content_id, page_number, l.fragment_id AS a, r.fragment_id AS b FROM linked WHERE content_id % 7 <> 0 AND (page_number + 1) % 5 <> 0),
x AS (SELECT content_id, page_number, 1 AS side, '[' || a || ']' AS part, '<!-- logical-table: table_' || a || '_' || b || '; source-pages: ' || page_number || ',' || (page_number + 1) || ' -->' || chr(10) || chr(10) || '| ' || a || ' |' || chr(10) || '| --- |' || chr(10) || '| ' || b || ' |' AS txt FROM ok
  UNION ALL SELECT content_id, page_number + 1, 0, '[' || b || ']', '' FROM ok),
y AS (SELECT content_id, page_number, max(part) FILTER (side = 0) AS p0, max(part) FILTER (side = 1) AS p1, max(txt) FILTER (side = 1) AS txt FROM x GROUP BY ALL)
SELECT content_id, page_number, md5(CASE WHEN p1 IS NULL THEN c ELSE replace(c, p1, txt) END) AS h FROM (SELECT content_id, page_number, p1, txt, CASE WHEN p0 IS NULL THEN content ELSE replace(content, p0, '') END AS c FROM pages_f LEFT JOIN y USING (content_id, page_number))""")
def logical_tables(spark, d):
    """Tables across pages as one recipe: links, headings that cancel them, merged rows, page contents."""
    fragments = source(spark, d, "fragments").withColumn("boundaries", F.array("b1", "b2"))
    listed = "array_join(transform(array_sort(collect_list(struct(ordinal, rendered))), x -> x.rendered), chr(10))"
    source(spark, d, "fragments").createOrReplaceTempView("quirelake_fragments")
    pages = spark.sql(_PAGES.format(listed=listed, fragments="quirelake_fragments"))
    rows = fragments.select("fragment_id", F.lit(0).alias("row_index"), F.array(F.col("fragment_id").cast("string")).alias("cells"), F.lit(False).alias("has_header"))
    return tables.logical_tables(pages, fragments, rows).select("content_id", "page_number", F.md5("content").alias("h"))


# ---- fusion ------------------------------------------------------------------------------------


@query(f"""{cte('cells')}, n AS (SELECT *, {_norm('value')} AS norm, CASE source WHEN 'qwen' THEN 0 WHEN 'glm' THEN 1 ELSE 2 END AS a, CASE source WHEN 'glm' THEN 0 WHEN 'docling' THEN 1 ELSE 2 END AS b FROM cells),
v AS (SELECT table_id, row_index, norm, count(*) AS n, min(a) AS a, arg_min(value, b) AS text FROM n WHERE norm <> '' GROUP BY ALL),
g AS (SELECT table_id, row_index, count(DISTINCT norm) FILTER (norm <> '') AS kinds, bool_and(source = 'qwen') FILTER (norm <> '') AS own, arg_min(value, a) FILTER (value <> '') AS raw FROM n GROUP BY ALL),
w AS (SELECT table_id, row_index, arg_min(text, a) AS text FROM v WHERE n >= 2 GROUP BY ALL)
SELECT table_id, row_index::BIGINT AS row_index, coalesce(w.text, raw, '') AS final, w.text IS NOT NULL AS consistent, w.text IS NULL AND kinds > 1 AS conflict, w.text IS NULL AND coalesce(own, false) AS qwen_only FROM g LEFT JOIN w USING (table_id, row_index)""")
def field_consensus(spark, d):
    return fusion.field_consensus(source(spark, d, "cells"), ["table_id", "row_index"])


@query(f"{cte('cells')}, n AS (SELECT table_id, row_index, {_norm('value')} AS norm, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT table_id, row_index, max(n) AS most, sum(n) AS s FROM n WHERE norm <> '' GROUP BY ALL) SELECT table_id, count(*) FILTER (most >= 2) AS agreements, sum(s)::BIGINT AS coverage FROM c GROUP BY table_id")
def evidence_strength(spark, d):
    return fusion.evidence_strength(source(spark, d, "cells").withColumnRenamed("row_index", "col"), ["table_id"])


@query(f"{cte('cells')}, q AS (SELECT table_id, row_index, count(DISTINCT source) FILTER ({_norm('value')} <> '') AS sources, bool_and(valid) AS valid FROM cells GROUP BY ALL) SELECT table_id, row_index::BIGINT AS row_index, sources, valid, CASE WHEN NOT valid AND sources = 0 THEN 'missing' WHEN NOT valid THEN 'conflicted' WHEN sources >= 2 THEN 'confirmed' ELSE 'selected' END AS quality FROM q")
def cell_quality(spark, d):
    return fusion.cell_quality(source(spark, d, "cells"), ["table_id", "row_index"])


@query(f"{cte('cells')}, s AS (SELECT table_id, row_index, count(DISTINCT {_norm('value')}) FILTER ({_norm('value')} <> '') AS kinds, count(*) FILTER ({_norm('value')} <> '') AS n FROM cells GROUP BY ALL) SELECT table_id, count(*) AS parsed, count(*) FILTER (n > kinds) AS agreed, count(*) FILTER (n = kinds AND kinds > 1) AS conflicts FROM s GROUP BY table_id")
def fusion_counters(spark, d):
    got = fusion.field_consensus(source(spark, d, "cells"), ["table_id", "row_index"])
    return got.groupBy("table_id").agg(F.count(F.lit(1)).alias("parsed"), F.count_if("consistent").alias("agreed"), F.count_if("conflict").alias("conflicts"))


@query(f"{cte('conflicts')} SELECT page_id, conflict_id, place FROM (SELECT page_id, conflict_id, row_number() OVER (PARTITION BY page_id ORDER BY has_date DESC, conflict_id) AS place FROM conflicts) WHERE place <= 24")
def conflict_topk(spark, d):
    return fusion.conflict_topk(source(spark, d, "conflicts"), ["page_id"]).select("page_id", "conflict_id", "place")


@query(f"{cte('conflicts')}, t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY has_date DESC, conflict_id) <= 24 AS top FROM conflicts) SELECT page_id, conflict_id, CASE WHEN top THEN coalesce(observed, final) ELSE final END AS final, top AND observed IS NOT NULL AS resolved FROM t")
def conflict_apply(spark, d):
    c = source(spark, d, "conflicts")
    return fusion.conflict_apply(c.drop("observed"), c.select("page_id", "conflict_id", "observed"), ["page_id"])


@query("""WITH v AS (SELECT conv_id, turn, 'company_name' AS field, trim(text) AS value FROM conversations UNION ALL SELECT conv_id, turn, 'statement_title', trim(text) FROM conversations UNION ALL SELECT conv_id, turn, 'unit', role FROM conversations),
n AS (SELECT *, NORM AS norm, count(*) OVER (PARTITION BY conv_id, field, NORM) AS n FROM v WHERE value <> ''), t AS (SELECT conv_id, NORM AS title FROM v WHERE field = 'statement_title' AND NORM <> ''),
h AS (SELECT n.*, CASE WHEN field = 'company_name' THEN (SELECT count(*) FROM t WHERE t.conv_id = n.conv_id AND contains(title, norm)) ELSE 0 END AS hits FROM n)
SELECT conv_id, field, value FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, field ORDER BY n DESC, hits DESC, turn) = 1""".replace("NORM", _norm("value")))
def metadata_vote(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    v = c.selectExpr("conv_id", "'company_name' field", "turn idx", "trim(text) value").union(c.selectExpr("conv_id", "'statement_title'", "turn", "trim(text)")).union(c.selectExpr("conv_id", "'unit'", "turn", "role"))
    return fusion.metadata_vote(v, ["conv_id"])


# ---- media -------------------------------------------------------------------------------------


@query(f"""{cte('videos')}, b AS (SELECT *, least(23, floor(t / greatest(duration / 24, 0.001)))::BIGINT AS bucket FROM videos) SELECT video_id, bucket, t, score FROM b QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, t) = 1""")
def bucket_top1(spark, d):
    return media.bucket_top1(source(spark, d, "videos"), "video_id").select("video_id", "bucket", "t", "score")


def _video_table(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, "videos").groupBy("video_id", "duration", "frame_rate").agg(F.collect_list(F.struct("t", "score")).alias("candidates"))


@query(f"""{cte('videos')}, v AS (SELECT video_id, duration, count(*) AS n, duration - CASE WHEN max(frame_rate) > 0 THEN least(greatest(0.05e0, 1.25e0 / max(frame_rate)), duration / 2) ELSE least(0.05e0, duration / 100) END AS e FROM videos GROUP BY video_id, duration),
b AS (SELECT video_id, t, score, row_number() OVER (PARTITION BY video_id, least(23, floor(t / greatest(duration / 24, 0.001e0))) ORDER BY score DESC, t) AS p FROM videos),
k AS (SELECT b.video_id, b.t, b.score FROM b JOIN v USING (video_id) WHERE v.n <= 22 OR p = 1 UNION ALL SELECT video_id, duration * i / 7, 0e0 FROM v, range(1, 7) r(i)),
o AS (SELECT k.video_id, least(e, greatest(0e0, t)) AS t, row_number() OVER (PARTITION BY k.video_id ORDER BY score DESC, t) AS i FROM k JOIN v USING (video_id)),
l AS (SELECT video_id, list(t ORDER BY i) AS ts FROM o GROUP BY video_id),
s AS (SELECT video_id, ts, 1 AS i, [0e0, e] AS got FROM l JOIN v USING (video_id)
  UNION ALL SELECT video_id, ts, i + 1, CASE WHEN len(got) < 24 AND len(list_filter(got, lambda g: abs(ts[i] - g) < 2.0)) = 0 THEN list_append(got, ts[i]) ELSE got END FROM s WHERE i <= len(ts))
SELECT video_id, unnest(got) AS t FROM s WHERE i = len(ts) + 1""")
def keyframe_select(spark, d):
    return media.keyframe_select(_video_table(spark, d), "video_id")


@query("WITH k AS (SELECT DISTINCT user_id AS video_id, event_id * 7 AS ms, 1000000 AS dur FROM events) SELECT video_id, row_number() OVER w AS scene, coalesce((lag(ms) OVER w + ms) // 2, 0) AS start_ms, coalesce((ms + lead(ms) OVER w) // 2, dur)::BIGINT AS end_ms FROM k WINDOW w AS (PARTITION BY video_id ORDER BY ms)")
def keyframe_scenes(spark, d):
    return media.keyframe_scenes(spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id video_id", "event_id * 7 ms", "1000000L duration_ms").distinct(), "video_id")


_LOG = "SELECT user_id AS video_id, event_id AS line_no, CASE event_id % 3 WHEN 0 THEN concat('frame pts_time:', CAST(event_id % 50 AS VARCHAR(20)), ' x') WHEN 1 THEN concat('lavfi.scene_score=0.', CAST(event_id % 10 AS VARCHAR(20))) ELSE 'noise' END AS line FROM {events}"


@query(f"""WITH g AS ({_LOG.format(events='events')}), p AS (SELECT *, try_cast(regexp_extract(line, 'pts_time:([0-9.]+)', 1) AS DOUBLE) AS t, try_cast(regexp_extract(line, 'scene_score=([0-9.]+)', 1) AS DOUBLE) AS s FROM g),
w AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY line_no) AS at_, count(t) OVER (PARTITION BY video_id ORDER BY line_no) AS grp FROM p),
f AS (SELECT video_id, grp, at_, arg_min(s, line_no) AS s, min(line_no) AS n FROM w WHERE s IS NOT NULL AND at_ IS NOT NULL GROUP BY ALL) SELECT video_id, at_ AS t, arg_min(s, n) AS score FROM f GROUP BY ALL""")
def scene_log(spark, d):
    return media.scene_candidates(spark.sql(_LOG.format(events=f"parquet.`{d}/events.parquet`")), "video_id")


@query(f"{cte('assets')} SELECT sha256(content) AS sha256, min(ord) AS first_ord, array_to_string(list_sort(list(DISTINCT location)), ',') AS locations, 'asset_' || substr(sha256(content), 1, 26) AS asset_id FROM assets GROUP BY content")
def asset_dedup(spark, d):
    return media.asset_dedup(source(spark, d, "assets")).withColumn("locations", F.array_join("locations", ","))


@query(f"{cte('assets')}, t AS (SELECT ord, location, sum(size) OVER (PARTITION BY location ORDER BY ord)::BIGINT AS total FROM assets) SELECT ord, total, total <= 100000 AS within FROM t")
def running_bytes(spark, d):
    return media.running_bytes(source(spark, d, "assets"), "location", 100000).select("ord", "total", "within")


# ---- jobs --------------------------------------------------------------------------------------


# each job walked event by event: an illegal move leaves the state
_WALK = f"""{cte('jobs_ev')}, o AS (SELECT job_id, id, status, "at" AS ts, row_number() OVER (PARTITION BY job_id ORDER BY id) AS i FROM jobs_ev),
walk AS (SELECT job_id, id, status, ts, i, 'start' AS verdict, status AS state FROM o WHERE i = 1
  UNION ALL SELECT o.job_id, o.id, o.status, o.ts, o.i, v.verdict, CASE WHEN v.verdict = 'allowed' THEN o.status ELSE w.state END FROM walk w JOIN o ON o.job_id = w.job_id AND o.i = w.i + 1,
    LATERAL (SELECT CASE WHEN w.state = o.status THEN 'same' WHEN (w.state = 'queued' AND o.status IN ('running', 'cancelled', 'failed')) OR (w.state = 'running' AND o.status IN ('completed', 'partial', 'failed', 'cancelled')) THEN 'allowed' ELSE 'error' END AS verdict) v)"""


@query(f"{_WALK} SELECT job_id, id, verdict FROM walk")
def job_state_machine(spark, d):
    return jobs.job_state_machine(source(spark, d, "jobs_ev")).select("job_id", "id", "verdict")


@query(f"{_WALK} SELECT job_id, arg_min(ts, id) FILTER (status = 'running') AS started_at, arg_max(ts, id) FILTER (status IN ('completed', 'partial', 'failed', 'cancelled')) AS completed_at, arg_max(state, id) AS status FROM walk WHERE verdict <> 'error' GROUP BY job_id")
def transition_side_effects(spark, d):
    return jobs.transition_side_effects(source(spark, d, "jobs_ev"))


@query(f"""{cte('jobs_ev')}, r AS (SELECT *, sum(CASE WHEN state = 'document.started' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY id) AS run,
  CASE WHEN starts_with(state, 'postprocess.') THEN total WHEN state IN ('document.started', 'page.processed', 'page.completed', 'page.warning', 'page.failed', 'unit.processed', 'frame.processed') THEN current END AS v FROM jobs_ev),
m AS (SELECT *, max(v) OVER (PARTITION BY job_id, run ORDER BY id) AS m FROM r) SELECT job_id, id, CASE WHEN run = 0 THEN coalesce(m, 0) ELSE m END::BIGINT AS live FROM m""")
def progress_merge(spark, d):
    return jobs.progress_merge(source(spark, d, "jobs_ev")).select("job_id", "id", "live")


@query(f"{cte('jobs_ev')} SELECT job_id, id AS event_id, i AS id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS i FROM jobs_ev) WHERE state <> 'heartbeat'")
def event_ids(spark, d):
    return jobs.event_ids(source(spark, d, "jobs_ev").withColumnRenamed("id", "event_id").withColumnRenamed("state", "event"), "job_id", ["event_id"]).select("job_id", "event_id", "id")


@query(f"{cte('jobs_ev')}, e AS (SELECT job_id, min(id) AS e FROM jobs_ev WHERE status IN ('completed', 'partial', 'failed', 'cancelled') GROUP BY job_id) SELECT j.job_id, j.id, j.status FROM jobs_ev j LEFT JOIN e USING (job_id) WHERE j.id > j.job_id * 10 AND (e IS NULL OR j.id <= e)")
def replay_after(spark, d):
    ev = source(spark, d, "jobs_ev")
    return jobs.replay_after(ev, ev.selectExpr("job_id", "job_id * 10 last_id").distinct()).select("job_id", "id", "status")


@query(f"{cte('jobs_ev')}, l AS (SELECT job_id, arg_max(status, id) AS status FROM jobs_ev GROUP BY job_id) SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'server_restarted' END AS error_code FROM l")
def restart_recovery(spark, d):
    last = jobs.latest(source(spark, d, "jobs_ev"), "job_id", [F.desc("id")]).selectExpr("job_id", "status", "cast(null as string) error_code")
    return jobs.restart_recovery(last)


@query("WITH m AS (SELECT event_type AS queue, event_id AS ord, CASE WHEN event_id % 7 < 4 THEN 1 ELSE -1 END AS mark FROM events), s AS (SELECT *, sum(mark) OVER (PARTITION BY queue ORDER BY ord)::BIGINT AS depth FROM m) SELECT queue, ord, depth, depth > 8 AS \"full\" FROM s")
def admission(spark, d):
    return jobs.admission(spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type queue", "event_id ord", "if(event_id % 7 < 4, 1, -1) mark")).select("queue", "ord", "depth", "full")


@query(f"{cte('jobs_ev')} SELECT job_id, id FROM jobs_ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) <= 5")
def event_history(spark, d):
    return jobs.event_history(source(spark, d, "jobs_ev"), 5).select("job_id", "id")


@query("SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def jobs_latest(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).selectExpr("o_orderkey job_id", "o_orderstatus status")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def jobs_expired(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate <= timestamp_ntz'2000-01-01'").orderBy("o_orderdate", "o_orderkey").limit(1000).selectExpr("o_orderkey job_id")


@query("WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey - 1 END AS p, o_orderkey % 5 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS a FROM orders) SELECT j.job_id, j.a AS attempt, k.a AS parent_attempt, j.a = k.a + 1 AS consistent FROM j JOIN j k ON j.p = k.job_id")
def retry_lineage(spark, d):
    j = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey job_id", "if(o_orderkey % 5 = 0, null, o_orderkey - 1) parent_job_id", "o_orderkey % 5 + if(o_orderkey % 11 = 0, 1, 0) attempt")
    return jobs.retry_lineage(j).select("job_id", "attempt", "parent_attempt", "consistent")


# ---- joins and sets that need no operator of their own -------------------------------------------


@query(f"{cte('evidence')} SELECT d.doc_id, e.chars, e.doc_id IS NOT NULL AS measured FROM documents d LEFT JOIN (SELECT * FROM evidence WHERE doc_id % 4 <> 0) e USING (doc_id)")
def page_evidence_join(spark, d):
    ev = source(spark, d, "evidence").where("doc_id % 4 <> 0").select("doc_id", "chars", F.lit(True).alias("m"))
    return spark.read.parquet(f"{d}/documents.parquet").join(ev, "doc_id", "left").select("doc_id", "chars", F.coalesce("m", F.lit(False)).alias("measured"))


@query("SELECT l_orderkey AS unit, coalesce(min(l_partkey % 50 / 1e2), 0.02e0) AS x0, coalesce(max(l_suppkey % 50 / 1e2 + 0.5e0), 0.98e0) AS x1 FROM lineitem GROUP BY l_orderkey")
def union_bbox(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey unit", "l_partkey % 50 / 1e2 x0", "l_suppkey % 50 / 1e2 + 5e-1 x1")
    return rows.groupBy("unit").agg(F.coalesce(F.min("x0"), F.lit(0.02)).alias("x0"), F.coalesce(F.max("x1"), F.lit(0.98)).alias("x1"))


@query("WITH lines AS " + LINES.format(lineitem="lineitem") + " SELECT l_orderkey AS a, l_linenumber::BIGINT AS i FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1")
def dropped_repeats(spark, d):
    """Lines all equal: with as many repeats allowed to go as there are, only the first stays."""
    rows = _lines(spark, d).selectExpr("l_orderkey a", "l_linenumber i", "'- same' text")
    extra = rows.selectExpr("a", "'same' norm", "99L n").distinct()
    kept = quality.repeated_lines_dropped(rows, ["a"], "i", "text", extra)
    return rows.join(kept.select("a", "i"), ["a", "i"], "left_anti").select("a", "i")


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def event_props(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- sources and sinks ---------------------------------------------------------------------------

_HEAD = "CASE doc_id % 11 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '49492A0008' WHEN 4 THEN '424D00' WHEN 5 THEN '5249464600000000574542505650' WHEN 6 THEN '524946460000000041564920' WHEN 7 THEN '000000186674797071742020' WHEN 8 THEN '00000018667479706D703432' WHEN 9 THEN '1A45DFA37765626D' ELSE '00' END"
_SUFFIX = "CASE doc_id % 3 WHEN 0 THEN '.mov' WHEN 1 THEN '.webm' ELSE '.bin' END"


@query(f"""WITH h AS (SELECT doc_id, {_HEAD} AS h, {_SUFFIX} AS s FROM documents) SELECT doc_id, CASE WHEN starts_with(h, '255044462D') THEN 'application/pdf' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '49492A00') THEN 'image/tiff'
  WHEN starts_with(h, '424D') THEN 'image/bmp' WHEN starts_with(h, '52494646') AND h[17:24] = '57454250' THEN 'image/webp' WHEN starts_with(h, '52494646') AND h[17:24] = '41564920' THEN 'video/x-msvideo'
  WHEN h[9:16] = '66747970' THEN CASE WHEN s = '.mov' OR contains(h, '71742020') THEN 'video/quicktime' ELSE 'video/mp4' END WHEN starts_with(h, '1A45DFA3') THEN CASE WHEN s = '.webm' OR contains(h, '7765626D') THEN 'video/webm' ELSE 'video/x-matroska' END END AS mime FROM h""")
def mime_detect(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_HEAD).alias("h"), F.expr(_SUFFIX).alias("s"))
    return rows.select("doc_id", readers.mime_type(F.col("h"), F.col("s")).alias("mime"))


_LAYOUT = """CASE doc_id % 5 WHEN 0 THEN concat('[{"index":3,"label":"Text","content":"c', CAST(doc_id AS VARCHAR(20)), '","bbox_2d":[1,2,3,4]},{"label":" Title "}]')
    WHEN 1 THEN '[{"label":"","bbox_2d":[1,2,3,4]}]' WHEN 2 THEN '[{"label":"x","bbox_2d":[5,2,3,4]}]' WHEN 3 THEN 'not json' ELSE '[{"index":-1,"label":"TABLE","bbox_2d":[0,0,1000,1000]}]' END"""


@query("""SELECT doc_id, 3::BIGINT AS "index", 'text' AS label, 'c' || doc_id AS content, '1.0,2.0,3.0,4.0' AS bbox, NULL AS error FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 1, 'title', '', NULL, NULL FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 0, 'table', '', '0.0,0.0,1000.0,1000.0', NULL FROM documents WHERE doc_id % 5 = 4
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE doc_id % 5 WHEN 1 THEN 'no_label' WHEN 2 THEN 'invalid_box' ELSE 'invalid_json' END FROM documents WHERE doc_id % 5 IN (1, 2, 3)""")
def layout_regions(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_LAYOUT).alias("j"))
    return readers.layout_regions(rows, "doc_id", "j").withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


@query("SELECT doc_id, 'a|b' || ',' || doc_id || ';x,' || lang AS grid FROM documents")
def markdown_table(spark, d):
    text = F.concat(F.lit("intro\n| a\\|b | "), F.col("doc_id").cast("string"), F.lit(" |\n| --- | :---: |\n| x | "), F.col("lang"), F.lit(" |\n"))
    grid = F.array_join(F.transform(readers.markdown_rows(text), lambda r: F.array_join(r, ",")), ";")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", grid.alias("grid"))


@query("WITH p AS (SELECT event_id, user_id, 10 + event_id % 50 AS d, event_id % 4 AS k FROM events) SELECT event_id, (d * 1000 + 500)::BIGINT AS duration_ms, 640::BIGINT AS width, 480::BIGINT AS height, 'h264' AS codec, CASE WHEN k = 0 THEN NULL ELSE 30000::DOUBLE / k END AS frame_rate FROM p")
def video_probe(spark, d):
    j = F.expr("""concat('{"format":{"duration":"', 10 + event_id % 50, '.5"},"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":640,"height":480,"avg_frame_rate":"30000/', event_id % 4, '"}]}')""")
    return readers.video_probe(spark.read.parquet(f"{d}/events.parquet").select("event_id", j.alias("j")), "event_id", "j")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'unsupported_version' END AS error, 'c' || doc_id AS content_id, 'completed' AS status FROM documents")
def result_gate(spark, d):
    j = F.expr("""concat('{"content_id":"c', doc_id, '","status":"completed"', case doc_id % 3 when 0 then ',"schema_version":"content-parse-result/1.0"' when 1 then ',"schema_version":"old"' else '' end, '}')""")
    return readers.gated_results(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", j.alias("j")), "doc_id", "j")


@query("SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_emit(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", sinks.sse_emit(F.col("event_id"), F.col("event_type"), F.col("props")).alias("frame"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, event_id::VARCHAR AS id, event_type AS event, props || chr(10) || 'more' AS data FROM events")
def sse_parse(spark, d):
    text = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\n: note\nevent: "), F.col("event_type"), F.lit("\ndata: "), F.col("props"), F.lit("\ndata:more\n"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("o", F.col("event_id") * 10 + F.col("i"))
    return readers.sse_frames(rows, "user_id", "o", "line")


_RANGE = "CASE doc_id % 6 WHEN 0 THEN 'bytes=10-20' WHEN 1 THEN 'bytes=100-' WHEN 2 THEN 'bytes=-50' WHEN 3 THEN 'bytes=1-2,4-5' WHEN 4 THEN 'bytes=9-3' ELSE 'bytes=999999-' END"


@query("""SELECT doc_id, CASE WHEN error IS NULL THEN s END AS "start", CASE WHEN error IS NULL THEN least(e, n_chars - 1) END AS "end", error FROM (SELECT *, CASE WHEN doc_id % 6 = 3 THEN 'invalid_range' WHEN e < s OR s >= n_chars THEN 'range_not_satisfiable' END AS error FROM (
  SELECT doc_id, n_chars, CASE doc_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN greatest(0, n_chars - 50) WHEN 4 THEN 9 ELSE 999999 END AS s, CASE doc_id % 6 WHEN 0 THEN 20 WHEN 4 THEN 3 ELSE n_chars - 1 END AS e FROM documents))""")
def byte_range(spark, d):
    start, end, error = sinks.byte_range(F.expr(_RANGE), F.col("n_chars"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", start.alias("start"), end.alias("end"), error.alias("error"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def job_upsert(spark, d):
    """All events, put over a state of every customer: those without an event stay as they were."""
    old = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit("old").alias("event_type"))
    return sinks.upsert(old, spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id"), "user_id", "event_id")


# ---- fuzzy and fold operators: no SQL form, values are held in the tests ---------------------------


@query(None)
def seq_ratio(spark, d):
    return source(spark, d, "pairs").select("doc_id", pyfuncs.seq_ratio("reference", "candidate").alias("ratio"))


@query(None)
def row_label_match(spark, d):
    rows = _lines(spark, d).selectExpr("l_orderkey table_id", "l_linenumber row_index", "concat('Position ', l_partkey % 30, ' total') label")
    targets = _lines(spark, d).selectExpr("l_orderkey table_id", "concat('position ', l_partkey % 29, ' Total') target")
    return fuzzy.row_label_match(targets, rows, ["table_id"])


@query("""WITH lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey AS t, p % 10 AS label, min(l_linenumber)::BIGINT AS i FROM lines GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey AS table_id, 'Row ' || (p % 9) AS target, i AS row_index FROM lines JOIN o ON t = l_orderkey AND label = p % 9""")
def row_label_exact(spark, d):
    rows = _lines(spark, d).selectExpr("l_orderkey table_id", "l_linenumber row_index", "concat('row ', l_partkey % 10) label")
    targets = _lines(spark, d).selectExpr("l_orderkey table_id", "concat('Row ', l_partkey % 9) target")
    return fuzzy.exact_label_match(targets, rows, ["table_id"])


@query(None)
def replay_trim(spark, d):
    rows = _lines(spark, d).selectExpr("l_orderkey table_id", "cast(l_linenumber % 2 as int) band", "l_linenumber row_index", "array(concat('r', l_partkey % 3), if(l_linenumber % 2 = 0, '1', '')) cells")
    return fuzzy.replay_trim(rows, ["table_id"]).select("table_id", "band", "row_index")


@query(None)
def overlap_dedup(spark, d):
    rows = _lines(spark, d).selectExpr("l_orderkey table_id", "l_linenumber row_index", "array(concat('r', l_partkey % 3), cast(l_suppkey % 2 as string), 'x') cells", "l_partkey % 5 strength")
    return fuzzy.overlap_dedup(rows, ["table_id"]).select("table_id", "row_index", "strength")


@query(None)
def continuation_repair(spark, d):
    rows = source(spark, d, "fragments").selectExpr("content_id", "page_number", "ordinal", "valid", "top", "bottom", "array(0.0D, 0.5D) boundaries", "if(fragment_id % 2 = 0, array(array('A', '', 'B'), array('1', '2', '3')), array(array('A', 'B'), array('1', '3'))) rows")
    return fuzzy.continuation_repair(rows).select("content_id", "page_number", "ordinal", F.size(F.col("rows")[0]).alias("width"))


@query(None)
def html_tables(spark, d):
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("<tr><th rowspan=2>h</th><td>"), x["l_partkey"].cast("string"), F.lit("</td></tr>"))), ""), F.lit("</table>")).alias("html"))
    return readers.html_tables(rows, "l_orderkey", "html")


@query(None)
def safe_filename(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", pyfuncs.safe_filename(F.col("url")).alias("name"))


# ---- further rules ---------------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("WITH i AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM documents) SELECT doc_id, n = 1 AS valid FROM i")
def input_exactly_one(spark, d):
    given = [F.when(F.col("doc_id") % k == 0, F.lit("x")) for k in (2, 3, 5)]
    return _docs(spark, d).select("doc_id", (sum((g.isNotNull().cast("int") for g in given), F.lit(0)) == 1).alias("valid"))


@query(f"{cte('pages_q')}, {_CODES} SELECT page_number, count(*) AS pages, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS codes FROM v WHERE len(codes) > 0 GROUP BY page_number")
def warning_log(spark, d):
    rows = quality.page_codes(source(spark, d, "pages_q"), ["content_id", "page_number"]).where(F.size("codes") > 0)
    return rows.groupBy("page_number").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))), ",").alias("codes"))


_JOBS = "SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'queued' END AS status, o_orderkey % 100 AS expires_at FROM {orders}"


@query(f"WITH j AS ({_JOBS.format(orders='orders')}) SELECT status, count(*) AS total, count(*) FILTER (expires_at <= 50 AND status IN ('completed', 'failed')) AS removed FROM j GROUP BY status")
def purge_counts(spark, d):
    return sinks.purge_counts(spark.sql(_JOBS.format(orders=f"parquet.`{d}/orders.parquet`")), F.lit(50))


@query(f"WITH j AS ({_JOBS.format(orders='orders')}) SELECT job_id FROM j WHERE NOT (expires_at <= 50 AND status IN ('completed', 'failed'))")
def retention_delete(spark, d):
    rows = spark.sql(_JOBS.format(orders=f"parquet.`{d}/orders.parquet`"))
    gone = rows.where(F.col("status").isin(*jobs.TERMINAL) & (F.col("expires_at") <= 50)).select("job_id")
    return rows.join(gone, "job_id", "left_anti").select("job_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS rendering FROM documents")
def renderings_flag(spark, d):
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("rendering"))


@query("SELECT doc_id, doc_id % 3 = 0 AS rejected FROM documents")
def removed_options(spark, d):
    given = F.expr("if(doc_id % 3 = 0, array('mode', 'languages'), array('languages'))")
    return _docs(spark, d).select("doc_id", F.arrays_overlap(given, F.array(F.lit("mode"), F.lit("output_format"), F.lit("include_diagnostics"))).alias("rejected"))


@query("WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'preview' WHEN 2 THEN 'keyframe' ELSE 'image' END AS kind, o_orderkey + 1 AS pid FROM orders) SELECT a.id, coalesce(p.id, a.id) AS shown FROM a LEFT JOIN (SELECT id, id - 1 AS parent FROM a WHERE kind = 'preview') p ON p.parent = a.id WHERE a.kind = 'image'")
def asset_gallery(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey id", "CASE o_orderkey % 4 WHEN 1 THEN 'preview' WHEN 2 THEN 'keyframe' ELSE 'image' END kind")
    preview = rows.where("kind = 'preview'").selectExpr("id pid", "id - 1 parent")
    return rows.where("kind = 'image'").join(preview, F.col("id") == F.col("parent"), "left").select("id", F.coalesce("pid", "id").alias("shown"))


_GLYPHED = "concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(173), chr(65533), {e000}) ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN chr(1) ELSE chr(10) END)"


@query("SELECT doc_id, 'U+' || CASE WHEN length(h) < 4 THEN lpad(h, 4, '0') ELSE h END AS glyph, count(*) AS n FROM (SELECT doc_id, to_hex(unicode(g)) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(replace(replace(t, chr(10), ''), chr(9), ''), '[\\p{Cc}\\p{Cf}\\p{Co}\\x{FFFD}]')) AS g FROM (SELECT doc_id, " + _GLYPHED.format(e000="chr(983040)") + " AS t FROM documents))) GROUP BY ALL")
def glyph_counts(spark, d):
    # beyond 255, chr works in DuckDB only
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\u00ad\ufffd\U000F0000").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "\u0001").otherwise("\n"))
    return quality.glyph_counts(_docs(spark, d).select("doc_id", text.alias("t")), ["doc_id"], "t")


@query("SELECT o_custkey AS rel, greatest(1, count(*) FILTER (o_orderkey % 3 = 0)) AS placements FROM orders GROUP BY o_custkey")
def placements(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("rel")).agg(F.greatest(F.lit(1).cast("long"), F.count_if(F.col("o_orderkey") % 3 == 0)).alias("placements"))


@query("SELECT source, count(*) AS units, sum(n_chars)::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT lang)), ',') AS kinds FROM documents GROUP BY source")
def result_overview(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("kinds"))


@query(f"{cte('pairs')}, c AS (SELECT doc_id, list_sort(string_split({_compact('reference')}, '')) = list_sort(string_split({_compact('candidate')}, '')) AS same FROM pairs) SELECT doc_id, same FROM c")
def multiset_equal(spark, d):
    sorted_ = lambda c: F.array_sort(F.split(T.compact_text(F.col(c)), ""))
    return source(spark, d, "pairs").select("doc_id", (sorted_("reference") == sorted_("candidate")).alias("same"))


@query("SELECT doc_id, doc_id % 12 = (doc_id * 7) % 12 AS same FROM documents")
def date_set_equal(spark, d):
    text = lambda k: F.concat(F.lit("2024年"), (F.col("doc_id") * k % 12 + 1).cast("string"), F.lit("月1日 2024 年"), (F.col("doc_id") * k % 12 + 1).cast("string"), F.lit("月 1 日"))
    return _docs(spark, d).select("doc_id", (T.date_tokens(text(1)) == T.date_tokens(text(7))).alias("same"))


@query("SELECT doc_id, 'Title ' || lang || chr(10) || chr(10) || 'quoted' || chr(10) || 'item ' || source || chr(10) || 'one & two <x> bold' || chr(10) || '\\**kept © é' AS t FROM documents")
def md_to_text(spark, d):
    text = F.concat(F.lit("# Title [`"), "lang", F.lit("`](http://x)\n\n> quoted\n- item ~~"), "source", F.lit("~~\n1. one &amp; two &lt;x&gt; **bold** <br/>\n\\**kept &copy; &#233;\n"))
    return _docs(spark, d).select("doc_id", T.markdown_to_text(text).alias("t"))


@query(f"{cte('blocks')} SELECT ord, CASE ord % 4 WHEN 1 THEN 1 - y1 WHEN 2 THEN 1 - x1 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE ord % 4 WHEN 1 THEN x0 WHEN 2 THEN 1 - y1 WHEN 3 THEN 1 - x1 ELSE y0 END AS y0 FROM blocks WHERE x1 <= 1 AND y1 <= 1")
def bbox_rotate(spark, d):
    rows = _with_box(source(spark, d, "blocks")).withColumn("b", G.valid(F.col("bbox"))).where("b is not null")
    return rows.withColumn("b", G.rotated(F.col("b"), F.col("ord") % 4 * 90)).selectExpr("ord", "b.left x0", "b.top y0")


@query("WITH c AS (SELECT doc_id, 1 + doc_id % 4 AS w, 2 + doc_id % 3 AS n FROM documents) SELECT doc_id, array_to_string(list_transform(range(0, w), lambda k: CASE WHEN k < n THEN 'c' || k ELSE '' END), ',') AS cells FROM c")
def row_values(spark, d):
    cells = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3 + 1).cast("int")), lambda k: F.concat(F.lit("c"), k.cast("string")))
    return _docs(spark, d).select("doc_id", F.array_join(T.row_values(cells, (F.col("doc_id") % 4 + 1).cast("int")), ",").alias("cells"))


@query("SELECT doc_id, doc_id % 3 <> 2 AS redundant FROM documents")
def redundant_header(spark, d):
    cells = F.expr("CASE doc_id % 3 WHEN 0 THEN array('Year 2024', '') WHEN 1 THEN array('year', ' SUM') ELSE array('Year', 'other') END")
    return _docs(spark, d).select("doc_id", T.redundant_header(F.array(F.lit("Year 2024"), F.lit("Sum total"), F.lit("")), cells).alias("redundant"))


@query("SELECT doc_id, lang || ',xx' AS languages FROM documents")
def languages_parse(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.languages(F.concat(F.upper("lang"), F.lit(" ,xx,,"), "lang", F.lit(", XX"))), ",").alias("languages"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_event(spark, d):
    return jobs.latest(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id"), "user_id", [F.desc("event_id")])
