"""Queries of the small rules, of text normalisation, and of input safety, and the SQL they are held against."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import normalise, plumbing
from quirelake.plans.inputs import cte, source
from quirelake.plans.registry import _docs, _with_box, query
from quirelake.sources import safety


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


# ---- inputs and jobs


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'report.PDF' WHEN 1 THEN 'report' || doc_id WHEN 2 THEN 'a.jpeg' WHEN 3 THEN 'b.docx' WHEN 4 THEN '.hidden' ELSE 'x.tar.tif' END AS name,
  CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff' ELSE NULL END AS mime, (doc_id % 9) * 30000000 AS size, doc_id % 1500 AS units FROM documents),
e AS (SELECT *, CASE WHEN doc_id % 6 IN (1, 4) THEN '' ELSE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) END AS suffix, CASE mime WHEN 'application/pdf' THEN ['.pdf'] WHEN 'image/jpeg' THEN ['.jpg', '.jpeg'] WHEN 'image/tiff' THEN ['.tif', '.tiff'] END AS ok FROM f),
h AS (SELECT *, CASE WHEN mime IS NULL THEN 'unsupported_file_type' WHEN suffix <> '' AND NOT list_contains(ok, suffix) THEN 'file_type_mismatch' END AS header FROM e)
SELECT doc_id, CASE WHEN header IS NULL THEN CASE WHEN suffix = '' THEN name || ok[1] ELSE name END END AS name, coalesce(CASE WHEN size <= 0 THEN 'empty_file' END, CASE WHEN size > 209715200 THEN 'file_too_large' END, header, CASE WHEN units > 1000 THEN 'too_many_units' END) AS error,
  CASE coalesce(CASE WHEN size <= 0 THEN 'empty_file' END, CASE WHEN size > 209715200 THEN 'file_too_large' END, header, 'x') WHEN 'empty_file' THEN 400 WHEN 'file_too_large' THEN 413 ELSE 415 END::BIGINT AS http_status FROM h""")
def file_validation(spark, d):
    """A stored file's first error, in order, the status it is answered with, and its name with an extension."""
    name = F.expr("CASE doc_id % 6 WHEN 0 THEN 'report.PDF' WHEN 1 THEN concat('report', doc_id) WHEN 2 THEN 'a.jpeg' WHEN 3 THEN 'b.docx' WHEN 4 THEN '.hidden' ELSE 'x.tar.tif' END")
    rows = _docs(spark, d).select("doc_id", name.alias("n"), F.expr("element_at(array('application/pdf', 'image/jpeg', 'image/tiff', null), cast(doc_id % 4 + 1 as int))").alias("mime"), F.expr("(doc_id % 9) * 30000000").alias("size"), F.expr("doc_id % 1500").alias("units"))
    own, header = plumbing.extension_agreement(F.col("n"), F.col("mime"))
    error = plumbing.file_error(F.col("size"), header, F.col("units"), F.coalesce("mime", F.lit("")))
    return rows.select("doc_id", own.alias("name"), error.alias("error"), plumbing.validation_status(F.coalesce(error, F.lit("x"))).alias("http_status"))


@query(f"{cte('uploads')} SELECT CASE WHEN starts_with(mime, 'video/') THEN 'video' WHEN contains(mime, 'openxmlformats') THEN 'office' ELSE 'pages' END AS pipeline, count(*) AS n, min(doc_id) AS first FROM uploads GROUP BY ALL")
def format_router(spark, d):
    """Three tables, one for each path."""
    parts = plumbing.split_pipelines(source(spark, d, "uploads"))
    counted = [p.groupBy(F.lit(name).alias("pipeline")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")) for name, p in parts.items()]
    return counted[0].union(counted[1]).union(counted[2])


_JOB = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'partial' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
  o_orderkey % 5 <> 0 AS there, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'content-parse-result/1.0' END AS version, o_orderkey % 4 AS busy, o_custkey % 3 AS workers, CASE WHEN o_orderkey % 3 = 0 THEN 'video' ELSE 'page' END AS kind FROM {orders}"""


@query(f"""WITH j AS ({_JOB.format(orders='orders')}) SELECT id, CASE WHEN status IN ('completed', 'running', 'queued') THEN 'job_not_retryable' WHEN NOT there THEN 'source_expired' END AS retry_error, status = 'failed' AND kind <> 'video' AS unit_retry,
  CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE 'deleted' END AS delete_action, CASE WHEN status NOT IN ('completed', 'partial') THEN 'result_not_ready' WHEN NOT there THEN 'result_missing' WHEN version IS DISTINCT FROM 'content-parse-result/1.0' THEN 'legacy_result_contract' END AS result_error,
  CASE WHEN busy >= workers THEN 'sync_capacity_exceeded' END AS sync_error FROM j""")
def job_gates(spark, d):
    """What may be done with a job: retry, retry of a unit, delete, read, answer at once."""
    c, rows = F.col, spark.sql(_JOB.format(orders=f"parquet.`{d}/orders.parquet`"))
    return rows.select(
        "id", plumbing.retry_error(c("status"), c("there")).alias("retry_error"), plumbing.unit_retryable(c("status"), c("kind")).alias("unit_retry"), plumbing.delete_action(c("status")).alias("delete_action"),
        plumbing.result_error(c("status"), c("there"), c("version")).alias("result_error"), plumbing.sync_error(c("busy"), c("workers")).alias("sync_error"),
    )


@query("SELECT 'job_' || o_orderkey AS id, o_orderstatus AS status, '/v1/content/jobs/job_' || o_orderkey AS status_url, '/v1/content/jobs/job_' || o_orderkey || '/events' AS events_url, '/v1/content/jobs/job_' || o_orderkey || '/result' AS result_url, '/v1/content/jobs/job_' || o_orderkey || '/assets' AS assets_url, '/v1/content/jobs/job_' || o_orderkey || '/bundle' AS bundle_url FROM orders")
def job_response(spark, d):
    """A job as it is shown: no paths, but addresses."""
    return plumbing.job_response(_orders(spark, d).selectExpr("concat('job_', o_orderkey) id", "o_orderstatus status", "'/tmp/x' source_path"))


@query("""WITH e AS (SELECT event_id, user_id % 90 AS cur, event_id % 40 AS tot, event_id % 9 AS n FROM events)
SELECT event_id, CASE WHEN tot <= 0 THEN 0e0 ELSE round_even(least(100e0, cur * 100e0 / tot), 1) END AS percent, least(15000, 750 * (1 << n))::BIGINT AS delay_ms,
  'job_' || list_aggregate(list_transform(range(9, -1, -1), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((1700000000000 + event_id) >> (5 * k)) & 31)::INT + 1, 1)), 'string_agg', '') || list_aggregate(list_transform(range(7, -1, -1), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((event_id >> (5 * k)) & 31)::INT + 1, 1)), 'string_agg', '') || '00000000' AS id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at, CASE WHEN event_id % 3 = 0 THEN event_id % 11 END AS warnings FROM e JOIN events USING (event_id)""")
def formats(spark, d):
    """Percentages, waiting times, sortable names, times, counts in details (progress percent, back-off, ULID, K9, K7)."""
    e = _events(spark, d)
    details = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"count":', event_id % 11, '}') WHEN 1 THEN '{"count":"x"}' ELSE '{"count":-4}' END""")
    random = F.concat(F.lpad(F.hex("event_id"), 10, "0"), F.lit("0000000000"))
    return e.select(
        "event_id", plumbing.progress_percent(F.col("user_id") % 90, F.col("event_id") % 40).alias("percent"), plumbing.reconnect_delay(F.col("event_id") % 9).alias("delay_ms"),
        plumbing.ulid("job", F.col("event_id") + 1700000000000, random).alias("id"), plumbing.iso_time(F.col("ts")).alias("at"), plumbing.warning_count(details).alias("warnings"),
    )


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'My file.pdf' WHEN 1 THEN 'plain.txt' WHEN 2 THEN 'a b' || doc_id || '.pdf' ELSE 'document' END AS name, 'attachment; filename=' || CASE doc_id % 2 WHEN 0 THEN 'Ab' || doc_id ELSE 'content' END || '.md; filename*=UTF-8''''' || CASE doc_id % 2 WHEN 0 THEN 'A%20b-' || doc_id ELSE '%E6%8A%A5' END || '.md' AS header,
  '''it''"''"''s ' || lang || '''' AS quoted FROM documents""")
def names(spark, d):
    """Names of downloads, from a response and for one, and quoted text."""
    said = F.expr("""CASE doc_id % 4 WHEN 0 THEN 'attachment; filename="My file.pdf"' WHEN 1 THEN 'inline; filename=plain.txt' END""")
    url = F.expr("CASE doc_id % 4 WHEN 2 THEN concat('https://h/x/a%20b', doc_id, '.pdf?q=/z') ELSE 'https://h' END")
    own = F.expr("CASE doc_id % 2 WHEN 0 THEN concat('A b-', doc_id, '.pdf') ELSE '报.pdf' END")
    return _docs(spark, d).select("doc_id", plumbing.download_filename(said, url).alias("name"), plumbing.download_header(own, ".md").alias("header"), plumbing.shell_quote(F.concat(F.lit("it's "), "lang")).alias("quoted"))


# ---- pages


@query("""WITH s AS (SELECT l_orderkey AS b, l_linenumber AS line, 'w' || min(l_partkey) || CASE WHEN min(l_partkey) % 50 = 0 THEN chr(61522) ELSE '' END AS t, (8 + min(l_suppkey) % 9)::DOUBLE AS size, min(l_suppkey) % 13 = 0 AS bold, min(l_partkey) % 50 = 0 AND min(l_suppkey) % 2 = 0 AS mark FROM lineitem GROUP BY ALL)
SELECT b AS block, md5(string_agg(t || ' end', chr(10) ORDER BY line)) AS h, max(size) AS max_size, bool_or(bold) AS bold, bool_or(mark) AS marked FROM s GROUP BY b""")
def block_text(spark, d):
    """Blocks from the spans of their lines."""
    one = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    font = F.expr("CASE WHEN s % 13 = 0 THEN 'Arial-BOLD' WHEN p % 50 = 0 AND s % 2 = 0 THEN 'Wingdings 2' ELSE 'Arial' END")
    spans = one.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("line"), "p", "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("span"))
    text = F.when(F.col("span") == 1, " end ").otherwise(F.concat(F.lit(" w"), F.col("p").cast("string"), F.when(F.col("p") % 50 == 0, "\uf052").otherwise("")))
    # a bold font is named in either span, the symbol font in the first
    font = F.when(F.col("p") % 50 == 0, F.when(F.col("s") % 2 == 0, F.concat(F.lit("Wingdings 2 "), F.when(F.col("s") % 13 == 0, "Bold").otherwise(""))).otherwise(font)).otherwise(font)
    got = plumbing.block_text(spans.select("block", "line", "span", text.alias("text"), font.alias("font"), (8 + F.col("s") % 9).cast("double").alias("size")), ["block"])
    return got.select("block", F.md5("text").alias("h"), "max_size", "bold", (F.size("mappings") > 0).alias("marked"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '| a | ' || doc_id || ' |' || chr(10) || '| --- |' END AS table, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: replace(lower(l), ' ', '') <> replace(lower(string_split(text, chr(10))[1]), ' ', '') OR trim(l) = ''), chr(10)), '^\\s+|\\s+$', '', 'g')) AS kept,
  doc_id % 4 IN (0, 1) AS short FROM documents""")
def content_lines(spark, d):
    """A fragment's table as the page has it now, lines that go, and short lines of CJK characters."""
    content = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('x\n<!-- table-fragment: f', doc_id, ' -->\n\n| a | ', doc_id, ' |\n| --- |\ntext') ELSE '<!-- table-fragment: f -->\n\nno table' END")
    first = F.array(F.upper(F.split("text", "\n")[0]), F.lit(" "))
    line = F.expr("CASE doc_id % 4 WHEN 0 THEN ' 公 司 ' WHEN 1 THEN '张' WHEN 2 THEN '四个汉字' ELSE '字a' END")
    return _docs(spark, d).select("doc_id", plumbing.refreshed_marker(content, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("table"), F.md5(plumbing.exact_lines_removed(F.col("text"), first)).alias("kept"), plumbing.short_cjk_line(line).alias("short"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'This image primarily contains parseable document content.' ELSE '该图片主要包含可解析的文档内容。' END ELSE 'seen' END AS summary,
  CASE WHEN doc_id % 3 = 0 OR length(source) > length(lang) + 1 THEN source ELSE lang || 'x' END AS visible, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END AS instructed, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'E' || doc_id || ',M' END AS errors FROM documents""")
def descriptions(spark, d):
    """Texts of described pictures, the language they are asked for in, errors of a conversion."""
    kind, lang = F.when(F.col("doc_id") % 3 == 0, "document").otherwise("visual"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("zh-CN")
    summary, visible = plumbing.measured_analysis(kind, F.col("source"), F.lit("seen"), F.concat("lang", F.lit("x")), lang)
    said = plumbing.language_instruction(lang)
    errors = F.expr("if(doc_id % 5 = 0, array(named_struct('error_message', '', 'message', cast(null as string))), array(named_struct('error_message', concat('E', doc_id), 'message', 'other'), named_struct('error_message', cast(null as string), 'message', 'M')))")
    return _docs(spark, d).select("doc_id", summary.alias("summary"), visible.alias("visible"), F.when(said.contains("in English and"), "en").when(said.contains("zh-CN"), "zh").alias("instructed"), F.array_join(plumbing.conversion_errors(errors), ",").alias("errors"))


@query(f"""{cte('blocks')}, c AS (SELECT ord, least(0.01e0, x0, 1 - x1) AS px, least(0.01e0, y0, 1 - y1) AS py, * EXCLUDE (ord) FROM blocks WHERE x1 <= 1 AND y1 <= 1),
p AS (SELECT ord, round_even((x0 - px) * 2000, 0)::BIGINT AS l, round_even((y0 - py) * 1500, 0)::BIGINT AS t, round_even((x1 + px) * 2000, 0)::BIGINT AS r, round_even((y1 + py) * 1500, 0)::BIGINT AS b FROM c)
SELECT ord, CASE WHEN r - l >= 2 AND b - t >= 2 THEN l || ',' || t || ',' || r || ',' || b END AS crop, CASE WHEN (ord % 900) * 3e0 * 700 * 3 > 4500000 THEN 3e0 * sqrt(4500000e0 / ((ord % 900) * 3e0 * 700 * 3)) ELSE 3e0 END AS scale FROM p""")
def pixels(spark, d):
    """Boxes in pixels with a margin, and scales within a budget (crop padding, pixel budget)."""
    rows = _with_box(source(spark, d, "blocks")).where("bbox.right <= 1 AND bbox.bottom <= 1")
    b = plumbing.crop_box(F.col("bbox"), F.lit(2000), F.lit(1500))
    return rows.select("ord", F.when(b.isNotNull(), F.concat_ws(",", b["left"], b["top"], b["right"], b["bottom"])).alias("crop"), plumbing.pixel_scale((F.col("ord") % 900).cast("double"), F.lit(700.0), F.lit(3.0), 4_500_000).alias("scale"))


@query("SELECT o_custkey AS page, least(1e0, sum(greatest((o_orderkey % 50) - 10e0, 0e0) * (o_orderkey % 30))::DOUBLE / 8000e0) AS cover FROM orders GROUP BY o_custkey")
def image_cover(spark, d):
    """Share of a page that its images cover."""
    rows = _orders(spark, d).selectExpr("o_custkey page", "100e0 page_width", "80e0 page_height", "10e0 x0", "0e0 y0", "cast(o_orderkey % 50 as double) x1", "cast(o_orderkey % 30 as double) y1")
    return plumbing.image_cover(rows, ["page"])


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'disabled' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'ready' WHEN 4 THEN 'disabled' WHEN 5 THEN 'unavailable' ELSE 'unknown' END AS status,
  CASE doc_id % 5 WHEN 0 THEN 'docling' WHEN 1 THEN 'glm' WHEN 2 THEN 'vlm' WHEN 3 THEN 'docling' ELSE 'own' END AS id, CASE doc_id % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_long' WHEN 2 THEN 'frontmatter' WHEN 3 THEN 'directive' WHEN 4 THEN 'interaction' WHEN 5 THEN 'style' WHEN 6 THEN 'url' WHEN 7 THEN 'embedded' END AS diagram FROM documents""")
def client_rules(spark, d):
    """States and names of back ends, and diagrams that are refused."""
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    c, none = F.col("doc_id") % 7, F.lit(None).cast("boolean")
    status = plumbing.backend_status(pick(7, "OK", "disabled", "failed", "", "", "", ""), F.when(c == 4, False).otherwise(none), F.when(c == 5, False).otherwise(none), F.when(c == 3, True).otherwise(none))
    sources = (" \n", "x" * 300, "---\na: 1", "graph %% {init}", "A-->B\nclick A", "  classDef x fill", "A --> B //host/x", "A ![x](y)", "graph TD\nA-->B")
    return _docs(spark, d).select("doc_id", status.alias("status"), plumbing.backend_id(pick(5, "Docling-Standard", "my-glm-x", "ollama", "the docling", "own")).alias("id"), plumbing.diagram_error(pick(9, *sources), 200, 50).alias("diagram"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace('Title ' || lang || chr(10) || 'code *x*'::VARCHAR || chr(10) || 'quoted ' || source || chr(10) || 'one two', '[*_~`]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def shown_text(spark, d):
    """Markdown as a viewer shows it, by rules of its own."""
    text = F.concat(F.lit("# Title "), "lang", F.lit("\n```py\ncode *x*\n```\n> quoted "), "source", F.lit("\n1. **one** [two](u)\n"))
    return _docs(spark, d).select("doc_id", F.md5(F.regexp_replace(plumbing.shown_text(text), "\n\n", "\n")).alias("h"))


# ---- joins and limits


@query("SELECT c_custkey AS page, coalesce(n, 0) AS n, coalesce(list, '') AS items FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS list FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def page_children(spark, d):
    """Pages with their tables or pictures."""
    pages = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("page"))
    kids = _orders(spark, d).selectExpr("o_custkey page", "o_orderkey ord", "cast(o_orderkey as string) item")
    return plumbing.page_children(pages, kids, ["page"], "ord", "item").select("page", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("items"))


@query(f"""{cte('blocks')}, o AS (SELECT *, row_number() OVER (PARTITION BY content_id, page_number ORDER BY ord) - 1 AS ordinal FROM blocks), k AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY page_number, ordinal) AS place FROM o WHERE x1 > x0 AND y1 > y0)
SELECT content_id, page_number, ord, ordinal FROM k WHERE place <= 50""")
def picture_candidates(spark, d):
    """Pictures with a size, numbered per page, up to a cap."""
    return plumbing.picture_candidates(_with_box(source(spark, d, "blocks")), ["content_id"], "ord", 50).select("content_id", "page_number", "ord", "ordinal")


@query("SELECT o_custkey AS content_id, count(*) AS n, 'too_many_assets' AS error FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def over_cap(spark, d):
    """Contents with more pictures than allowed: an error, no cut (L4)."""
    return plumbing.over_cap(_orders(spark, d).selectExpr("o_custkey content_id"), ["content_id"], 12, "too_many_assets")


@query("SELECT doc_id, code FROM (SELECT doc_id, lang AS code FROM documents UNION ALL SELECT doc_id, source FROM documents) WHERE code NOT IN ('en', 'de')")
def resolved_removed(spark, d):
    """Warnings that a later step has not resolved (U8)."""
    rows = _docs(spark, d).selectExpr("doc_id", "lang code").union(_docs(spark, d).selectExpr("doc_id", "source code"))
    return plumbing.resolved_removed(rows, ["en", "de"])


_ASSETS = "SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 3 = 0 THEN 'preview' ELSE 'image' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS parent_id, o_custkey AS content_id, o_orderkey % 4 AS relationship_id FROM {orders}"


@query(f"WITH a AS ({_ASSETS.format(orders='orders')}), f AS (SELECT event_id AS frame, event_id % 20000 AS asset_id FROM events) SELECT frame, asset_id, asset_id IN (SELECT asset_id FROM a) AS found, p.asset_id AS preview_id FROM f LEFT JOIN (SELECT parent_id, asset_id FROM a WHERE kind = 'preview') p ON p.parent_id = f.asset_id".replace("SELECT frame, asset_id, asset_id IN", "SELECT frame, f.asset_id, f.asset_id IN"))
def keyframe_assets(spark, d):
    """Keyframes with their picture and its preview."""
    frames = _events(spark, d).selectExpr("event_id frame", "event_id % 20000 asset_id")
    return plumbing.keyframe_assets(frames, spark.sql(_ASSETS.format(orders=f"parquet.`{d}/orders.parquet`"))).select("frame", "asset_id", "found", "preview_id")


@query(f"""WITH a AS (SELECT DISTINCT content_id, relationship_id, content_id * 10 + relationship_id AS asset_id FROM ({_ASSETS.format(orders='orders')})), u AS (SELECT DISTINCT user_id AS content_id, event_id % 5 AS unit_index FROM events),
p AS (SELECT user_id AS content_id, event_id % 5 AS unit_index, event_id % 4 AS relationship_id, event_id FROM events) SELECT event_id, 'unit-' || p.unit_index AS unit_id, asset_id FROM p JOIN u USING (content_id, unit_index) JOIN a USING (content_id, relationship_id) WHERE (p.content_id + p.unit_index) % 6 <> 0""")
def placed_assets(spark, d):
    """Embedded pictures at the units that are not excluded."""
    e = _events(spark, d)
    units = e.selectExpr("user_id content_id", "event_id % 5 unit_index").distinct().selectExpr("*", "concat('unit-', unit_index) unit_id", "(content_id + unit_index) % 6 = 0 excluded")
    assets = spark.sql(_ASSETS.format(orders=f"parquet.`{d}/orders.parquet`")).select("content_id", "relationship_id").distinct().selectExpr("*", "content_id * 10 + relationship_id asset_id")
    return plumbing.placed_assets(e.selectExpr("user_id content_id", "event_id % 5 unit_index", "event_id % 4 relationship_id", "event_id"), units, assets).select("event_id", "unit_id", "asset_id")


@query("""WITH c AS (SELECT user_id, event_id AS page_number, CASE event_id % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_error' ELSE 'ok' END AS outcome FROM events), t AS (SELECT user_id, min(page_number) AS first FROM c WHERE outcome = 'timeout' GROUP BY user_id)
SELECT user_id, page_number, CASE WHEN page_number > first THEN 'skipped_after_timeout' ELSE outcome END AS outcome FROM c LEFT JOIN t USING (user_id)""")
def stop_after_timeout(spark, d):
    """After a timeout no later page of a content is asked for."""
    return plumbing.stop_after_timeout(_events(spark, d).selectExpr("user_id", "event_id page_number", "CASE event_id % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_error' ELSE 'ok' END outcome"), "user_id")


@query("""WITH c AS (SELECT user_id, event_id, (event_id % 100)::DOUBLE AS s, row_number() OVER w AS i, coalesce(sum((event_id % 100)::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, i <= 3 AND used < 120 AS made, greatest(0e0, 120 - used) AS "left" FROM c""")
def call_budget(spark, d):
    """Calls that a page has left, in number and in time (T-11)."""
    return plumbing.call_budget(_events(spark, d).selectExpr("user_id", "event_id", "event_id ord", "cast(event_id % 100 as double) seconds"), ["user_id"], 3, 120.0).select("user_id", "event_id", "made", "left")


# ---- normalisation


@query("SELECT doc_id, md5('标题，' || lang || ' 内容 （' || source || '） ' || text) AS h FROM documents")
def cjk_spaces(spark, d):
    """Spaces inside CJK text go."""
    text = F.concat(F.lit("标 题 ， "), "lang", F.lit(" 内\t容 （ "), "source", F.lit(" ） "), "text")
    return _docs(spark, d).select("doc_id", F.md5(normalise.cjk_spaces(text)).alias("h"))


@query("SELECT doc_id, md5('GB/T ' || doc_id || ' 附录 A 图B 表　C' || chr(10) || '## D.1 犃' || lang || chr(10) || ' A ２ ' || chr(10) || text) AS h FROM documents")
def contextual_glyphs(spark, d):
    """Broken glyphs where the context is clear."""
    text = F.concat(F.lit("犌 犅 ／犜 "), F.col("doc_id").cast("string"), F.lit(" 附录 犃 图犅 表　犆\n## 犇.1 犃"), "lang", F.lit("\n 犃 ２ \n"), "text")
    return _docs(spark, d).select("doc_id", F.md5(normalise.contextual_glyphs(text)).alias("h"))


@query(r"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)))), ' ')) AS words, md5(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[./:+-][A-Za-z0-9]+)+'), lambda w: lower(w)))), ' ')) AS compounds, '中国,国人' AS boundaries FROM documents")
def native_lexicon(spark, d):
    """What native text knows: words, compounds, spaced pairs (part of P12)."""
    known = normalise.lexicon(_docs(spark, d).select("doc_id", "text", F.concat("text", F.lit(" 中 国\t人")).alias("t")), ["doc_id"], "t")
    return known.select("doc_id", F.md5(F.array_join(F.array_sort("words"), " ")).alias("words"), F.md5(F.array_join(F.array_sort("compounds"), " ")).alias("compounds"), F.array_join(F.array_sort("boundaries"), ",").alias("boundaries"))


@query("""SELECT doc_id, CASE WHEN lang <> reverse(lang) THEN '1.2' ELSE '' END AS sections FROM documents""")
def heading_order_mismatch(spark, d):
    """Numbered headings whose characters stand in another order than in the native text."""
    native = F.concat(F.lit("1.1 Title one\n1.2. "), F.reverse("lang"), F.lit("\n1.3 Only here"))
    page = F.concat(F.lit("# 1.1 Title  one\n\n## 1.2 other\n## 1.2 "), "lang", F.lit("\n"))
    return _docs(spark, d).select("doc_id", F.array_join(normalise.heading_mismatches(page, normalise.headings(native, False)), ",").alias("sections"))


@query(f"""{cte('blocks', 'tables')}, t AS (SELECT *, (x0 * 100)::INT % 9 + 0.5 AS v FROM tables), b AS (SELECT *, ord % 9 + 0.5 AS v FROM blocks),
p AS (SELECT DISTINCT content_id, page_number FROM blocks), gone AS (SELECT DISTINCT b.content_id, b.page_number, b.v FROM b JOIN t USING (content_id, page_number) WHERE (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1),
has AS (SELECT DISTINCT content_id, page_number, v FROM t), l AS (SELECT content_id, page_number, unnest(range(0, 9)) + 0.5 AS v FROM p)
SELECT content_id, page_number, count(*) FILTER (v IN (SELECT v FROM gone g WHERE g.content_id = l.content_id AND g.page_number = l.page_number) AND v IN (SELECT v FROM has h WHERE h.content_id = l.content_id AND h.page_number = l.page_number)) AS removed FROM l GROUP BY ALL""")
def number_lines_removed(spark, d):
    """Loose numbers that a table of the page has, at its place."""
    blocks = _with_box(source(spark, d, "blocks")).withColumn("text", F.concat(F.lit("n "), (F.col("ord") % 9).cast("string"), F.lit(".5")))
    boxes = source(spark, d, "tables").withColumn("markdown", F.concat(F.lit("| "), (F.round(F.col("x0") * 100).cast("int") % 9).cast("string"), F.lit(".5 |")))
    pages = blocks.select("content_id", "page_number").distinct().withColumn("content", F.lit("\n".join([f" {k}.5" for k in range(9)] + ["end"])))
    return normalise.number_lines_removed(pages, blocks, _with_box(boxes)).select("content_id", "page_number", "removed")


@query(None)
def text_normalize(spark, d):
    """The recipe of text normalisation over whole texts, with the next document as native evidence (P12 with S7, S8, J19, J20)."""
    docs = _docs(spark, d)
    native = docs.selectExpr("doc_id - 1 doc_id", "text native_text")
    return normalise.text_normalize(docs.selectExpr("doc_id", "text content"), native, ["doc_id"]).select("doc_id", F.md5("content").alias("h"), "changed", F.array_join("codes", ",").alias("codes"))


@query(None)
def split_headings(spark, d):
    """Split headings rejoined where the native text has them whole."""
    content = F.concat(F.lit("# A "), "lang", F.lit("\n\n# "), "source", F.lit("\n\n## x\n\n## y\n"))
    return _docs(spark, d).select("doc_id", normalise.split_headings(content, F.array(F.concat(F.lit("A"), "lang", "source"))).alias("content"))


@query(None)
def glyph_map(spark, d):
    """Characters that stand for others, by matching blocks with the native text."""
    content = F.concat("source", F.lit("\ue001 ⼀x"), "lang")
    mapping = normalise.glyph_map(T.compact_text(content), T.compact_text(F.concat("source", F.lit("é 一x"), "lang")))
    return _docs(spark, d).select("doc_id", normalise.glyphs_replaced(content, mapping).alias("content"))


# ---- safety


@query(None)
def source_url(spark, d):
    """The policy for addresses to fetch from (A4)."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", safety.source_url(F.col("url"), F.lit(None).cast("array<string>")).alias("s")).select("page_id", "s.*")


def _archives(rows):
    """Small office documents and unsafe archives, made from ids."""

    def make(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    types = "presentationml.presentation" if i % 2 else "wordprocessingml.document"
                    z.writestr("[Content_Types].xml", f'<Types><Override ContentType="application/vnd.openxmlformats-officedocument.{types}.main+xml"/></Types>')
                    z.writestr("ppt/presentation.xml" if i % 2 else "word/document.xml", "<x/>")
                    for k in range(i % 5):
                        z.writestr(f"ppt/slides/slide{k + 1}.xml", "<x/>")
                    if i % 7 == 3:
                        z.writestr("../x", "y")
                    if i % 11 == 5:
                        z.writestr("big", b"\0" * (3 << 20))
                    target = "%252e%252e/%252e%252e/x" if i % 13 == 6 else "media/a.png"
                    z.writestr("word/media/a.png", b"png")
                    z.writestr("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="r1" Type="t/image" Target="{target}" TargetMode="{"External" if i % 17 == 8 else "Internal"}"/></Relationships>')
                out.append(buffer.getvalue() if i % 19 else b"no archive")
            yield pd.DataFrame({"id": pdf["id"], "content": out})

    return rows.mapInPandas(make, "id long, content binary")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 19 = 0 THEN 'invalid_ooxml' WHEN doc_id % 7 = 3 THEN 'archive_path_traversal' WHEN doc_id % 11 = 5 THEN 'archive_suspicious_ratio' WHEN doc_id % 17 = 8 THEN 'ooxml_external_relationship' WHEN doc_id % 13 = 6 THEN 'archive_path_traversal' WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN 'empty_document' END AS error,
  CASE WHEN doc_id % 19 = 0 OR doc_id % 7 = 3 OR doc_id % 11 = 5 OR doc_id % 17 = 8 OR doc_id % 13 = 6 OR (doc_id % 2 = 1 AND doc_id % 5 = 0) THEN NULL WHEN doc_id % 2 = 0 THEN 1 ELSE doc_id % 5 END AS units FROM documents""")
def office_safety(spark, d):
    """Archives: safe entries, safe relationships, what document it is."""
    return safety.office_errors(_archives(_docs(spark, d).selectExpr("doc_id id")), "id", "content").select("id", "error", "units")


@query("SELECT doc_id AS id, 1::BIGINT AS unit_index, 'r1' AS rel, 'word/media/a.png' AS place, 3::BIGINT AS size FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 7 <> 3 AND doc_id % 11 <> 5 AND doc_id % 17 <> 8 AND doc_id % 13 <> 6")
def office_images(spark, d):
    """Pictures that office documents refer to."""
    files = _archives(_docs(spark, d).selectExpr("doc_id id"))
    entries = safety.zip_entries(files, "id", "content")
    good = files.join(safety.archive_errors(entries, "id").where("error is null").select("id"), "id", "left_semi")
    return safety.office_images(safety.relationships(good, "id", "content"), entries, "id").selectExpr("id", "unit_index", "rel_id rel", "resolved place", "size")
