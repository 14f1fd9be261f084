"""Queries of recipes and of what they are made of: bands, added rows, order repair, contracts, renderings, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import contract, fusion, jobs, layout, order, recipes, tables, units, visual
from quirelake.plans import registry
from quirelake.plans.inputs import INPUTS, cte, source
from quirelake.plans.registry import _LINKED, _PAGES, _docs, _lines, _with_box, query
from quirelake.sources import readers, sinks


_BLOCKS = INPUTS["blocks_once"].format(lineitem="lineitem")


def _once(name: str) -> str:
    """The SQL of a query over blocks, over those that are keys."""
    return registry._ORACLE[name].replace(INPUTS["blocks"].format(lineitem="lineitem"), _BLOCKS)


_PAGE = cte("blocks", "tables").replace(INPUTS["blocks"].format(lineitem="lineitem"), _BLOCKS)


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def _talks(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


# ---- bands


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 90 AS r, o_custkey % 12 AS c, greatest(1, 3 - o_orderkey % 3) AS calls, greatest(1, ceil(greatest(1, o_orderkey % 90 - 1) / 20e0))::BIGINT AS wanted, 1000 + o_orderkey % 77 AS height FROM orders),
b AS (SELECT *, least(greatest(1, calls - CASE WHEN wanted > 1 AND calls >= 3 THEN 1 ELSE 0 END), wanted)::BIGINT AS bands, greatest(2, round_even(height * 0.015e0, 0))::BIGINT AS over_ FROM o), e AS (SELECT *, unnest(range(0, bands)) AS band FROM b)
SELECT id, r >= 20 AND c >= 8 AS parallel, band, greatest(0, floor(height * band / bands::DOUBLE)::BIGINT - over_) AS top, least(height, ceil(height * (band + 1) / bands::DOUBLE)::BIGINT + over_) AS bottom FROM e""")
def band_plan(spark, d):
    """Bands of dense tables within the calls left, and their pixel rows (F16)."""
    rows = _orders(spark, d).selectExpr("o_orderkey id", "o_orderkey % 90 row_lines", "o_custkey % 12 column_lines", "o_orderkey % 3 calls", "1000 + o_orderkey % 77 height")
    return visual.band_edges(visual.band_plan(rows)).select("id", "parallel", "band", "top", "bottom")


_BANDS = "SELECT DISTINCT conv_id, turn AS band, 'left' AS table_id, CASE WHEN turn % 7 = 6 THEN 3 ELSE 2 END AS width FROM {c} UNION SELECT DISTINCT conv_id, turn, 'right', 2 FROM {c} WHERE turn % 5 <> 4"


@query(f"""WITH t AS ({_BANDS.format(c='conversations')}), f AS (SELECT conv_id, min(band) AS first FROM t GROUP BY conv_id), l AS (SELECT t.conv_id, table_id, width FROM t JOIN f ON t.conv_id = f.conv_id AND band = first),
i AS (SELECT conv_id, list_sort(list(table_id)) AS ids FROM l GROUP BY conv_id), o AS (SELECT conv_id, band, list_sort(list(table_id)) AS own FROM t GROUP BY ALL), w AS (SELECT t.conv_id, band, bool_or(t.width <> l.width) AS wide FROM t LEFT JOIN l USING (conv_id, table_id) GROUP BY ALL)
SELECT conv_id, band, CASE WHEN own <> ids THEN 'table_ids' WHEN wide THEN 'column_width' END AS error FROM o JOIN i USING (conv_id) JOIN w USING (conv_id, band)""")
def layout_contract(spark, d):
    """Bands that change a table's layout."""
    rows = spark.sql(_BANDS.format(c=f"parquet.`{d}/conversations.parquet`")).withColumn("columns", F.expr("transform(sequence(1, width), k -> concat('c', k, '_', band))"))
    return visual.layout_contract(rows, "conv_id").select("conv_id", "band", "error").distinct()


@query("""WITH c AS (SELECT conv_id, turn AS band, min(role) AS role FROM conversations GROUP BY ALL), r AS (SELECT conv_id, band, 0 AS i, CASE WHEN band % 3 = 0 THEN '' ELSE role END AS a, 'T' || (band % 2) AS b FROM c UNION ALL SELECT conv_id, band, 1, 'h' || (band % 4), 'x' FROM c WHERE band % 3 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(a), lower(b) ORDER BY band, i) AS p FROM r) SELECT conv_id, 1::BIGINT AS place, row_number() OVER (PARTITION BY conv_id ORDER BY band, i) - 1 AS out_index, a, b FROM k WHERE p = 1""")
def band_combine(spark, d):
    """The rows of a table over its bands (F11, with F12, K1, K2)."""
    c = _talks(spark, d).groupBy("conv_id", F.col("turn").alias("band")).agg(F.min("role").alias("role")).withColumn("table_id", F.lit("single")).withColumn("columns", F.array(F.lit("Role"), F.lit("Sum total")))
    data = c.selectExpr("conv_id", "band", "table_id", "columns", "0 row_index", "'data' kind", "array(if(band % 3 = 0, null, role), concat('T', band % 2)) cells")
    more = c.selectExpr("conv_id", "band", "table_id", "columns", "1", "if(band % 3 = 0, 'header', 'data')", "if(band % 3 = 0, array('sum', ''), array(concat('h', band % 4), 'x', 'cut'))")
    return visual.band_combine(data.union(more), "conv_id").selectExpr("conv_id", "cast(place as bigint) place", "out_index", "cells[0] a", "cells[1] b")


_ANSWER = """concat('{"company_name":null,"tables":[{"table_id":"', CASE doc_id % 9 WHEN 0 THEN 'other' WHEN 1 THEN 'left' ELSE 'single' END, '","columns":["a"', CASE WHEN doc_id % 9 = 2 THEN '' ELSE ',"b"' END, '],"rows":[{"kind":"', CASE WHEN doc_id % 9 = 3 THEN 'x' ELSE 'data' END, '","cells":["', CASE WHEN doc_id % 9 = 4 THEN ' ' ELSE 'k' END, '","', CAST(doc_id AS VARCHAR(20)), '"]},{"kind":"data","cells":["合计","2"]}]}', CASE WHEN doc_id % 9 = 5 THEN ',{"table_id":"single","columns":["a"],"rows":[{"kind":"header","cells":["a"]}]}' WHEN doc_id % 9 = 6 THEN ',{"table_id":"left","columns":["a"],"rows":[{"kind":"header","cells":["a"]}]}' ELSE '' END, ']', CASE WHEN doc_id % 9 = 7 THEN '' ELSE '}' END)"""


@query("""WITH e AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'table_id' WHEN 1 THEN 'not_parallel' WHEN 2 THEN 'row_width' WHEN 3 THEN 'row_kind' WHEN 4 THEN 'row_labels' WHEN 5 THEN 'repeated_ids' WHEN 6 THEN 'mixed_ids' WHEN 7 THEN 'invalid_json' END AS error FROM documents)
SELECT doc_id, NULL AS table_id, NULL::BIGINT AS row_index, NULL AS cells, error FROM e WHERE error IS NOT NULL UNION ALL SELECT doc_id, 'single', unnest([0, 1]), unnest(['k|' || doc_id, '合计|2']), NULL FROM e WHERE error IS NULL""")
def band_answers(spark, d):
    """Answers for bands, held to their form and limits."""
    bands = _docs(spark, d).select("doc_id", F.expr(_ANSWER.replace("VARCHAR(20)", "STRING")).alias("j"), (F.col("doc_id") % 9 == 1).alias("p"))
    return visual.band_answers(bands, "j", "p").select("doc_id", "table_id", "row_index", F.array_join("cells", "|").alias("cells"), "error")


# ---- rows that sources add, lines that repeat: labels are compared by ratio


@query("""WITH lines AS (SELECT l_orderkey AS t, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), once AS (SELECT t, p, min(i) AS i, min(s) AS s FROM lines WHERE i > 1 GROUP BY t, p HAVING count(*) = 1)
SELECT l.t AS table_id, l.i::BIGINT AS row_index, unnest([0, 1])::BIGINT AS col, unnest(['Nr ' || md5(l.p::VARCHAR), o.s::VARCHAR]) AS value FROM lines l JOIN once o ON o.t = l.t AND o.p = l.p""")
def attached_evidence(spark, d):
    """What a source says for the cells of a table (J12); labels that differ are far apart here, so that the exact ones decide."""
    base = _lines(spark, d)
    table = base.selectExpr("l_orderkey table_id", "l_linenumber row_index", "array(concat('NR  ', upper(md5(cast(l_partkey as string)))), 'own') cells")
    other = base.selectExpr("l_orderkey table_id", "l_linenumber - 1 row_index", "array(concat('Nr ', md5(cast(l_partkey as string))), cast(l_suppkey as string), 'beyond') cells")
    return visual.attached(table, other, ["table_id"]).selectExpr("table_id", "cast(row_index as bigint) row_index", "cast(col as bigint) col", "value")


@query(None)
def supplement_rows(spark, d):
    """Rows that a source has and a table lacks, at their place."""
    base = _lines(spark, d)
    table = base.where("l_linenumber % 2 = 1").selectExpr("l_orderkey table_id", "l_linenumber row_index", "array(concat('Position ', l_partkey), '1') cells")
    other = base.selectExpr("l_orderkey table_id", "l_linenumber row_index", "array(concat('Position ', l_partkey), '2') cells", "false has_header")
    return visual.supplement_rows(table, other, ["table_id"]).select("table_id", "row_index", F.array_join("cells", "|").alias("cells"), "added")


@query(None)
def line_groups(spark, d):
    """Repeated lines by groups, and lines that misread a company's name."""
    docs = _docs(spark, d)
    lines = T.lines(F.col("text"))
    once = docs.select("doc_id", F.concat(F.lit("某某股份有限公司\n某某股分有限公司\n"), F.array_join(visual.lines_deduplicated(lines, F.slice(lines, 1, 1)), "\n")).alias("content"), F.lit("某某股份有限公司").alias("company"))
    return visual.company_variants_dropped(once).select("doc_id", F.md5("content").alias("h"))


@query(None)
def grid_anchor(spark, d):
    """Cells in order of arrival: those out of bounds or in taken places are refused, with reasons."""
    cells = _lines(spark, d).selectExpr("l_orderkey table_id", "4 num_rows", "4 num_cols", "l_linenumber arrival", "cast(l_partkey % 5 as int) top", "cast(l_partkey % 5 + 1 + l_suppkey % 2 as int) bottom", "cast(l_suppkey % 3 as int) left", "cast(l_suppkey % 3 + 1 as int) right")
    return tables.grid_anchor(cells, ["table_id"]).select("table_id", F.array_join(F.col("arrivals").cast("array<string>"), ",").alias("kept"), F.array_join("reasons", ",").alias("reasons"))


# ---- pages


@query(f"""{_LINKED}, pages_f AS ({_PAGES.format(listed="string_agg(rendered, chr(10) ORDER BY ordinal)", fragments="fragments")})
SELECT content_id, l.fragment_id AS left_id, r.fragment_id AS right_id, content_id % 7 = 0 OR (page_number + 1) % 5 = 0 AS blocked FROM linked""")
def heading_between(spark, d):
    """Links that a heading between the two tables cancels (F8)."""
    fragments = source(spark, d, "fragments").withColumn("boundaries", F.array("b1", "b2"))
    source(spark, d, "fragments").createOrReplaceTempView("quirelake_fragments")
    pages = spark.sql(_PAGES.format(listed="array_join(transform(array_sort(collect_list(struct(ordinal, rendered))), x -> x.rendered), chr(10))", fragments="quirelake_fragments"))
    return tables.heading_between(tables.cross_page_link(fragments), pages, fragments).select("content_id", "left_id", "right_id", "blocked")


@query("""WITH p AS (SELECT doc_id, lang AS content FROM documents), w AS (SELECT doc_id, 'repeated_text' AS code FROM documents UNION ALL SELECT doc_id, 'other' FROM documents)
SELECT 'page' AS kind, doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS value FROM documents UNION ALL SELECT 'fragment', doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END FROM documents UNION ALL SELECT 'warning', doc_id, code FROM w WHERE doc_id % 3 <> 0 OR code = 'other'""")
def page_overlay(spark, d):
    """Adopted pages replace pages, fragments and resolved warnings."""
    docs = _docs(spark, d)
    new = docs.where("doc_id % 3 = 0")
    warned = docs.selectExpr("doc_id", "'repeated_text' code").union(docs.selectExpr("doc_id", "'other'"))
    pages, fragments, warnings = fusion.adopt(docs.selectExpr("doc_id", "lang v"), docs.selectExpr("doc_id", "'old' v"), warned, new.selectExpr("doc_id", "source v"), new.selectExpr("doc_id", "'new' v"), ["doc_id"])
    one = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "doc_id", F.col(c).alias("value"))
    return one(pages, "page", "v").union(one(fragments, "fragment", "v")).union(one(warnings, "warning", "code"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'auto_visual' ELSE 'off' END AS policy, CASE doc_id % 3 WHEN 0 THEN 1.5e0 WHEN 1 THEN 2e0 ELSE 2.5e0 END AS scale, CASE doc_id % 3 WHEN 0 THEN least(2e0, 1e0 + doc_id % 4) WHEN 1 THEN 1e0 + doc_id % 4 ELSE greatest(3e0, 1e0 + doc_id % 4) END AS ocr FROM documents")
def profile_policy(spark, d):
    """What a profile stands for."""
    profile = F.expr("element_at(array('fast', 'balanced', 'accurate'), cast(doc_id % 3 + 1 as int))")
    policy, scale, ocr = units.profile_settings(profile, (1.0 + F.col("doc_id") % 4).cast("double"))
    return _docs(spark, d).select("doc_id", policy.alias("policy"), scale.alias("scale"), ocr.alias("ocr"))


@query("SELECT doc_id, lang || '=' || doc_id || ',' || source || '=7' AS toc, CASE WHEN doc_id % 2 = 0 THEN '# 目录' || chr(10) || chr(10) || '- ' || lang || ' …… ' || doc_id || chr(10) || '- ' || source || ' …… 7' || chr(10) || '- z …… 9' END AS page FROM documents")
def toc_lines(spark, d):
    """Lines of a table of contents, and the page that is one."""
    text = F.concat("lang", F.lit(" ..... "), F.col("doc_id").cast("string"), F.lit("\nno entry\n"), "source", F.lit("……… · ....7 "))
    page = F.concat(F.when(F.col("doc_id") % 2 == 0, " 目录 \n").otherwise("目录页\n"), text, F.lit("\nz....9"))
    return _docs(spark, d).select("doc_id", F.array_join(F.transform(T.toc_entries(text), lambda e: F.concat(e["title"], F.lit("="), e["page"])), ",").alias("toc"), T.directory_page(page).alias("page"))


@query("""WITH p AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) SELECT conv_id, md5(string_agg('<!-- page: ' || turn || ' -->' || chr(10) || chr(10) || '# ' || role || chr(10) || '- item **' || turn || '**', chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY turn)) AS markdown,
  md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || chr(10) || role || chr(10) || 'item ' || turn, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY turn)) AS plain FROM p GROUP BY conv_id""")
def document_rendering(spark, d):
    """Pages joined to one text, normalised."""
    rows = _talks(spark, d).groupBy("conv_id", F.col("turn").alias("page_number")).agg(F.min("role").alias("role"))
    content = F.concat(F.lit("\r\n# "), "role", F.lit("  \r\n- item **"), F.col("page_number").cast("string"), F.lit("**\n\n"))
    return sinks.document_rendering(rows.withColumn("content", content), "conv_id").select("conv_id", F.md5("markdown").alias("markdown"), F.md5("plain_text").alias("plain"))


@query("""WITH r AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL), t AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '# ' || role WHEN 1 THEN '## ' || role WHEN 2 THEN '<!-- image -->' || chr(10) || chr(10) || role WHEN 3 THEN '| ' || role || ' |' WHEN 4 THEN role END AS t FROM r)
SELECT conv_id AS content_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn), '') AS markdown FROM t GROUP BY conv_id""")
def region_markdown(spark, d):
    """Pages written from layout regions."""
    rows = _talks(spark, d).groupBy(F.col("conv_id").alias("content_id"), F.col("turn").alias("ord")).agg(F.min("role").alias("role")).withColumn("page_number", F.lit(1))
    label = F.expr("CASE ord % 6 WHEN 2 THEN 'image' WHEN 3 THEN 'table' ELSE 'text' END")
    native = F.expr("CASE ord % 6 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'paragraph_title' ELSE 'text' END")
    content = F.when(F.col("ord") % 6 == 5, " ").otherwise(F.col("role"))
    rendered = F.when(F.col("ord") % 6 == 3, F.concat(F.lit("| "), "role", F.lit(" |")))
    return layout.region_markdown(rows.select("content_id", "page_number", "ord", label.alias("label"), native.alias("native_label"), content.alias("content"), rendered.alias("rendered"))).select("content_id", "markdown")


@query(f"""{_PAGE}, ro AS ({{order}}), hf AS ({{heading}}) SELECT content_id, page_number, md5(string_agg(CASE WHEN heading THEN '## ' ELSE '' END || text, chr(10) || chr(10) ORDER BY reading_order)) AS h FROM blocks JOIN ro USING (content_id, page_number, ord) JOIN hf USING (content_id, page_number, ord) GROUP BY ALL""".replace("{order}", _once("reading_order")).replace("{heading}", _once("heading_flag")))
def native_markdown(spark, d):
    """Pages written from their native blocks (C17)."""
    return layout.native_markdown(_with_box(source(spark, d, "blocks_once")).withColumn("page_width", F.lit(1.0))).select("content_id", "page_number", F.md5("markdown").alias("h"))


@query(None)
def native_order_repair(spark, d):
    """Pages whose paragraphs stand in another order than their native blocks, repaired."""
    docs = _docs(spark, d).selectExpr("doc_id content_id", "1 page_number", "filter(split(text, '\\\\.'), x -> char_length(trim(x)) > 12) parts")
    pages = docs.selectExpr("content_id", "page_number", "array_join(if(content_id % 2 = 0, reverse(parts), parts), '\n\n') content", "'native' source_kind", "600 page_width", "800 page_height")
    blocks = docs.select("content_id", "page_number", F.posexplode("parts").alias("ord", "text")).selectExpr("*", "50D left", "10D * ord top", "500D right", "10D * ord + 9 bottom")
    none = spark.createDataFrame([], "content_id long, page_number int, ordinal int, rendered string, left double, top double, right double, bottom double")
    return order.native_order_repair(pages, blocks, none).select("content_id", "code", F.md5("content").alias("h"))


# ---- the contract


@query(f"""{_PAGE}, ro AS ({_once('reading_order')}), hf AS ({_once('heading_flag')}), kb AS ({_once('block_not_in_table')}),
t AS (SELECT *, row_number() OVER (PARTITION BY content_id, page_number ORDER BY x0, y0, x1, y1) AS k FROM tables),
r AS (SELECT content_id, page_number, 'p' || page_number || '-r' || reading_order AS region_id, CASE WHEN heading THEN 'heading' ELSE 'text' END AS kind, x0, y0, reading_order AS o FROM blocks JOIN kb USING (content_id, page_number, ord) JOIN ro USING (content_id, page_number, ord) JOIN hf USING (content_id, page_number, ord)
  UNION ALL SELECT content_id, page_number, 'p' || page_number || '_t' || k || '-region', 'table', x0, y0, 1000000 + k FROM t
  UNION ALL SELECT -1, doc_id, 'p' || doc_id || '-r1', 'text', NULL, NULL, 1 FROM documents WHERE doc_id % 4 <> 0)
SELECT content_id, page_number, region_id, kind, row_number() OVER (PARTITION BY content_id, page_number ORDER BY coalesce(y0, 2), coalesce(x0, 2), o) AS reading_order FROM r""")
def contract_regions(spark, d):
    """All regions of all units (the greater part of P7)."""
    return _regions(spark, d)[1].select("content_id", "page_number", "region_id", "kind", "reading_order")


def _regions(spark, d):
    blocks = _with_box(source(spark, d, "blocks_once")).withColumn("page_width", F.lit(1.0))
    boxes = contract.table_ordinals(source(spark, d, "tables"), ["x0", "y0", "x1", "y1"])
    grids = _with_box(boxes)
    plain = _docs(spark, d).selectExpr("cast(-1 as bigint) content_id", "doc_id page_number", "if(doc_id % 4 = 0, '| x |', concat('text\n| y |\n', lang)) content", "if(doc_id % 13 = 0, 'failed', 'completed') status")
    pages = blocks.select("content_id", "page_number").distinct().selectExpr("content_id", "page_number", "'' content", "'completed' status").unionByName(plain)
    return pages, contract.regions(pages, blocks, grids)


@query(f"""{_PAGE}, kb AS ({_once('block_not_in_table')}), b AS (SELECT content_id, page_number, count(*) AS n FROM kb GROUP BY ALL), t AS (SELECT content_id, page_number, count(*) AS n FROM tables GROUP BY ALL),
p AS (SELECT DISTINCT content_id, page_number, 'completed' AS status FROM blocks UNION ALL SELECT -1, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'completed' END FROM documents),
u AS (SELECT p.content_id, p.page_number, status, coalesce(b.n, 0) + CASE WHEN p.content_id = -1 AND p.page_number % 4 <> 0 THEN 1 ELSE 0 END AS blocks, coalesce(t.n, 0) AS tables FROM p LEFT JOIN b ON b.content_id = p.content_id AND b.page_number = p.page_number LEFT JOIN t ON t.content_id = p.content_id AND t.page_number = p.page_number)
SELECT 'content-parse-result/1.0' AS schema_version, content_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS status, count(*) AS units, sum(blocks)::BIGINT AS blocks, sum(tables)::BIGINT AS tables, array_to_string(list('p' || page_number ORDER BY page_number), ',') AS unit_ids FROM u GROUP BY content_id""")
def contract_contents(spark, d):
    """Contents as they are published: units in order, regions, blocks, tables, status."""
    got = contract.contents(contract.units(*_regions(spark, d)))
    total = lambda c: F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.size(u[c]))
    return got.select("schema_version", "content_id", "status", F.size("units").alias("units"), total("block_ids").alias("blocks"), total("table_ids").alias("tables"), F.array_join(F.transform("units", lambda u: u["unit_id"]), ",").alias("unit_ids"))


# ---- recipes


@query(None)
def prepared_pages(spark, d):
    """Pages from raw text to verdict, with native evidence."""
    docs = _docs(spark, d).selectExpr("doc_id content_id", "1 page_number", "text", "source", "filter(split(text, '\\\\.'), x -> char_length(trim(x)) > 12) parts")
    pages = docs.selectExpr("content_id", "page_number", "array_join(if(content_id % 3 = 0, reverse(parts), parts), '\n\n') content", "if(content_id % 2 = 0, 'native', 'mixed') source_kind", "600 page_width", "800 page_height", "'completed' status", "0 rotation", "char_length(text) native_chars", "false fused", "0 conflicts")
    blocks = docs.select("content_id", "page_number", F.posexplode("parts").alias("ord", "text")).selectExpr("*", "50D left", "10D * ord top", "500D right", "10D * ord + 9 bottom")
    none = spark.createDataFrame([], "content_id long, page_number int, ordinal int, rendered string, left double, top double, right double, bottom double")
    got = recipes.prepared_pages(pages, docs.selectExpr("content_id", "page_number", "text native_text"), blocks, none)
    return got.select("content_id", "status", "verdict", "strategy", F.array_join("codes", ",").alias("codes"), F.md5("content").alias("h"))


@query("""SELECT doc_id AS content_id, 'Printed line ' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '某某公司章' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '张三' || chr(10) END || 'end' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '<!-- image -->' ELSE '' END AS content FROM documents""")
def signature_pages(spark, d):
    """Pages with seals and handwriting (P4, with F18, R3, S20); repeats are exact here."""
    i = F.col("doc_id")
    text = F.concat(F.lit("Printed line "), i.cast("string"), F.lit("\nPrinted  line "), i.cast("string"), F.lit("\n某某公司章\n张三\nend"))
    pages = _docs(spark, d).select(i.alias("content_id"), F.lit(1).alias("page_number"), text.alias("content"))
    line = F.concat(F.lit("printed line "), i.cast("string"))
    sealed = F.when(i % 3 == 0, F.array(line)).otherwise(F.array(F.lit("某某公司章"), line))
    seen = _docs(spark, d).select(i.alias("content_id"), F.lit(1).alias("page_number"), F.array(line, F.lit("end")).alias("printed"), F.array(line).alias("repeated"), sealed.alias("sealed"), (i % 2 == 0).alias("marked"))
    return recipes.signature_pages(pages, seen).select("content_id", "content")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# ZZ' || chr(10) || chr(10) || 'U' || chr(10) || chr(10) || 'a NEW b  c ' || lang WHEN 1 THEN '# ZZ' || chr(10) || chr(10) || 'U' || chr(10) || chr(10) || 'text' || chr(10) || chr(10) || 'NEW' ELSE '# ZZ' || chr(10) || chr(10) || 'the U' || chr(10) || chr(10) || 'NEW' END AS content FROM documents""")
def replaced_tables(spark, d):
    """Tables of a page replaced, and what it lacks of its title, company, date and unit put on top."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a [1] b [2] c "), "lang")).when(F.col("doc_id") % 3 == 1, "text\n| x |\n<!-- table-fragment: f -->").otherwise("the U\n| x |")
    new = recipes.replaced_tables(content, F.array(F.lit("[1]"), F.lit("[2]"), F.lit("")), F.lit("NEW"))
    none = F.lit(None).cast("string")
    return _docs(spark, d).select("doc_id", new.alias("c")).select("doc_id", recipes.with_metadata(F.col("c"), F.lit("ZZ"), none, F.lit(""), F.lit("U")).alias("content"))


@query("""WITH a AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_orderkey % 4 > 0) SELECT c_custkey AS content_id, coalesce('text' || chr(10) || chr(10) || '## 图片资产' || chr(10) || chr(10) || l, 'text ' || chr(10)) AS markdown FROM customer LEFT JOIN (SELECT c, string_agg('- `a' || k || '`：' || CASE WHEN k % 2 = 0 THEN 'long ' || k ELSE 'short' END || CASE WHEN k % 3 = 0 THEN chr(10) || '  - 可见文本：x' || chr(10) || '    y' ELSE '' END, chr(10) || chr(10) ORDER BY k) AS l FROM a GROUP BY c) ON c = c_custkey""")
def picture_texts(spark, d):
    """Descriptions of pictures below a content."""
    k = F.col("o_orderkey")
    assets = _orders(spark, d).select(F.col("o_custkey").alias("content_id"), k.alias("ord"), F.concat(F.lit("a"), k.cast("string")).alias("asset_id"), F.when(k % 4 > 0, "short").alias("summary"), F.when(k % 4 > 0, F.when(k % 2 == 0, F.concat(F.lit("long "), k.cast("string"))).otherwise("")).alias("detailed"), F.when(k % 3 == 0, " x\ny ").alias("visible"))
    contents = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("content_id"), F.lit("text \n").alias("markdown"))
    return recipes.picture_texts(contents, assets)


@query(f"""{registry._ORACLE['keyframe_select'].rsplit('SELECT video_id, unnest(got)', 1)[0]}, ms AS (SELECT DISTINCT video_id, floor(unnest(got) * 1000 + 0.5)::BIGINT AS ms FROM s WHERE i = len(ts) + 1)
SELECT video_id, row_number() OVER w AS scene, coalesce((lag(ms) OVER w + ms) // 2, 0) AS start_ms, coalesce((ms + lead(ms) OVER w) // 2, 60000)::BIGINT AS end_ms, row_number() OVER w <= 8 AS in_summary FROM ms WINDOW w AS (PARTITION BY video_id ORDER BY ms)""")
def video_scenes(spark, d):
    """Keyframes and the scenes around them (P11, with F17, F10, L5)."""
    return recipes.video_scenes(registry._video_table(spark, d), "video_id").select("video_id", "scene", "start_ms", "end_ms", "in_summary")


def _lines_of_pages(spark, d):
    """_lines, a page's rows in one partition of some 100,000. The line is an aggregate, so that filters on it stay above and all who read
    these rows share one exchange."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // 100_000)
    once = rows.repartition(parts, "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("line"))
    return once.agg(F.min("l_linenumber").alias("l_linenumber"), F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).drop("line")


@query(None)
def fused_tables(spark, d):
    """Tables read in bands, completed and checked by other sources (P3, with F11 to F13, J12 to J14, G10, G11, G21)."""
    base = _lines_of_pages(spark, d)
    label = "concat('Nr ', md5(cast(l_partkey as string)))"
    band = base.where("l_linenumber % 3 <> 0").selectExpr("l_orderkey page", "cast(l_linenumber % 2 as int) band", "'single' table_id", "array('Item', 'Sum') columns", "l_linenumber row_index", "'data' kind", f"array({label}, cast(l_suppkey as string)) cells")
    glm = base.selectExpr("l_orderkey page", "'single' table_id", "l_linenumber row_index", f"array({label}, cast(l_suppkey + if(l_partkey % 4 = 0, 1, 0) as string)) cells", "false has_header")
    docling = glm.where("row_index % 2 = 0")
    return recipes.fused_tables(band, {"glm": glm, "docling": docling}, "page")[0].select("page", F.md5("markdown").alias("h"), "parsed", "agreed", "conflicts", "qwen_only")


# ---- records and reports


@query(f"""{cte('jobs_ev')} SELECT job_id, id, CASE WHEN state IN ('page.completed', 'page.warning', 'page.failed') THEN state ELSE 'job.progress' END AS name, CASE WHEN state = 'page.processed' THEN 'page_pipeline' ELSE state END AS phase,
  CASE WHEN state IN ('page.completed', 'page.warning', 'page.failed') AND current BETWEEN 1 AND 20 THEN current * 2 - 1 END AS page FROM jobs_ev""")
def event_rename(spark, d):
    """Events as they are shown, with the page that an ended one means (T-6)."""
    name, phase = jobs.event_rename(F.col("state"))
    page = jobs.event_page(F.col("state"), F.col("current"), F.expr("transform(sequence(1, 20), k -> k * 2 - 1)"))
    return source(spark, d, "jobs_ev").select("job_id", "id", name.alias("name"), phase.alias("phase"), page.cast("bigint").alias("page"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS most, count(*) FILTER (event_id % 2 = 0) AS ok, avg(event_id) AS mean FROM events GROUP BY event_type")
def run_report(spark, d):
    """Successes, mean and maximum of runs."""
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("most"), F.count_if(F.col("event_id") % 2 == 0).alias("ok"), F.avg("event_id").alias("mean"))


@query("SELECT doc_id, '1-' || doc_id AS unit_range, lang AS language, doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS legacy, 'unit_range,vlm' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ',x' END AS kept FROM documents".replace("'unit_range,vlm' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ',x' END", "'language,unit_range'"))
def legacy_record(spark, d):
    """Records of an older form: renamed and unknown options, flagged (K5)."""
    key = F.when(F.col("doc_id") % 2 == 0, "page_range").otherwise("unit_range")
    text = F.concat(F.lit('{"object":"'), F.when(F.col("doc_id") % 5 == 0, "old").otherwise("content.parse.job"), F.lit('","options":{"'), key, F.lit('":"1-'), F.col("doc_id").cast("string"), F.lit('","language":"'), "lang", F.when(F.col("doc_id") % 3 == 0, '","dropped":"x"}}').otherwise('"}}'))
    options, legacy = readers.decoded_record(text, ["unit_range", "language", "profile"])
    return _docs(spark, d).select("doc_id", options["unit_range"].alias("unit_range"), options["language"].alias("language"), legacy.alias("legacy"), F.array_join(F.array_sort(F.map_keys(options)), ",").alias("kept"))


@query(None)
def binary_sources(spark, d):
    """Files as bytes, with their digest, and an error for those over the cap (A2)."""
    return readers.binary_sources(spark, f"{d}/nation.parquet", cap=1 << 20).select("length", "sha256", "mime", "error")


@query("SELECT logical_table_id, array_to_string(list(fragment_id::VARCHAR ORDER BY page_number, ordinal), ',') AS fragments, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS units FROM (SELECT o_custkey AS content_id, 'table_' || (o_orderkey % 3) AS logical_table_id, o_orderkey AS fragment_id, o_orderkey % 12 AS page_number, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 3 > 0) GROUP BY content_id, logical_table_id")
def logical_members(spark, d):
    """Logical tables with their fragments and units."""
    rows = _orders(spark, d).selectExpr("o_custkey content_id", "if(o_orderkey % 3 > 0, concat('table_', o_orderkey % 3), null) logical_table_id", "o_orderkey fragment_id", "o_orderkey % 12 page_number", "o_orderkey ordinal")
    got = contract.logical_tables(rows)
    return got.select("logical_table_id", F.array_join(F.col("fragment_ids").cast("array<string>"), ",").alias("fragments"), F.array_join(F.col("source_units").cast("array<string>"), ",").alias("units"))
