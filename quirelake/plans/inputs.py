"""Inputs derived from the tables, in SQL that both engines read alike: {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: lineitem repeats line numbers; one row each where they are keys.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"

INPUTS = {
    # measured evidence of a page
    "evidence": """SELECT doc_id, (n_chars * 7) % 120 AS chars, ((doc_id * 37) % 101) / 1e2 AS cover,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ((doc_id * 13) % 50) / 1e3 END AS ink, doc_id % 7 AS h, (doc_id * 5) % 8 AS v,
        ((doc_id * 3) % 10) / 1e1 AS grid_w, ((doc_id * 7) % 10) / 1e1 AS grid_h, ((doc_id * 17) % 60) / 1e2 AS grid_area,
        (600 + doc_id % 300) / 1e0 AS width, (600 + (doc_id * 11) % 300) / 1e0 AS height, (doc_id % 4) * 90 AS rotation,
        doc_id % 3 = 0 AS failed, doc_id % 2 AS regions, doc_id % 5 = 0 AS hint, doc_id % 10 = 0 AS placeholder, doc_id % 7 = 0 AS repeated
        FROM {documents}""",
    # blocks with boxes, in hundredths of the page
    "blocks": """SELECT l_suppkey AS content_id, l_orderkey % 40 AS page_number, l_orderkey * 10 + l_linenumber AS ord,
        ((l_partkey * 7) % 70) / 1e2 AS x0, ((l_orderkey * 13) % 90) / 1e2 AS y0,
        ((l_partkey * 7) % 70 + (l_partkey * 3) % 30 + 1) / 1e2 AS x1, ((l_orderkey * 13) % 90 + l_linenumber * 2) / 1e2 AS y1,
        concat('Block number ', CAST(l_partkey % 4 AS VARCHAR(20))) AS text, (8 + l_partkey % 9) / 1e0 AS size, l_linenumber = 7 AS bold FROM {lineitem}""",
    "tables": """SELECT o_custkey % 100 + 1 AS content_id, o_orderkey % 40 AS page_number,
        ((o_orderkey * 7) % 50) / 1e2 AS x0, ((o_orderkey * 11) % 50) / 1e2 AS y0,
        ((o_orderkey * 7) % 50 + 20 + o_orderkey % 30) / 1e2 AS x1, ((o_orderkey * 11) % 50 + 20 + o_orderkey % 25) / 1e2 AS y1 FROM {orders}""",
    # pages with a status and content of many kinds
    "pages_q": """SELECT doc_id AS content_id, doc_id % 5 AS page_number, CASE WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS status,
        CASE doc_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN '| same | same | same | same | same | x |'
            WHEN 3 THEN concat('��', substr(text, 1, 20)) WHEN 4 THEN '犚犲犿犪狀狌犳' WHEN 6 THEN concat('| a | 12.5% |', chr(10), '12.5%', chr(10), text) WHEN 5 THEN '|1|2|3|4|5|6|7|8|9|a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|q|' ELSE text END AS content,
        CASE doc_id % 6 WHEN 0 THEN 'sparse' WHEN 1 THEN 'native' WHEN 2 THEN 'scanned' ELSE 'mixed' END AS source_kind,
        (doc_id % 5) * 90 AS rotation, n_chars * (1 + doc_id % 8) AS native_chars, doc_id % 4 = 0 AS fused, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 3 END AS conflicts,
        doc_id % 19 <> 0 AS measured, CASE WHEN doc_id % 10 = 1 THEN 'native' ELSE 'docling' END AS strategy, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id % 4 END AS calls, doc_id % 3 AS resolved FROM {documents}""",
    "marked": """SELECT doc_id, concat('# ', text, ' **', CAST(n_chars AS VARCHAR(20)), '.', CAST(doc_id % 100 AS VARCHAR(20)), '%** | (−', CAST(doc_id AS VARCHAR(20)), ') <!-- note --> 2024 年',
        CAST(doc_id % 12 + 1 AS VARCHAR(20)), '月', CAST(doc_id % 28 + 1 AS VARCHAR(20)), '日') AS text FROM {documents}""",
    "pairs": """SELECT a.doc_id, a.text AS reference, b.text AS candidate FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1""",
    # a cell as three sources read it
    "cells": " UNION ALL ".join(
        f"""SELECT l_orderkey AS table_id, l_linenumber AS row_index, '{name}' AS source, {value} AS value, l_suppkey % 9 <> 0 AS valid FROM {LINES} l"""
        for name, value in (
            ("qwen", "CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN CAST(l_partkey + 2 AS VARCHAR(20)) ELSE CAST(l_partkey AS VARCHAR(20)) END"),
            ("glm", "CASE WHEN l_partkey % 7 = 0 THEN concat(' ', CAST(l_partkey + 1 AS VARCHAR(20))) ELSE CAST(l_partkey AS VARCHAR(20)) END"),
            ("docling", "CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN concat('−', CAST(l_partkey AS VARCHAR(20))) ELSE CAST(l_partkey AS VARCHAR(20)) END"),
        )
    ),
    "conflicts": """SELECT l_suppkey AS page_id, concat('t', CAST(l_orderkey % 3 AS VARCHAR(20)), 'r', CAST(l_orderkey AS VARCHAR(20)), 'c', CAST(l_linenumber AS VARCHAR(20))) AS conflict_id,
        l_partkey % 10 = 0 AS has_date, CAST(l_partkey AS VARCHAR(20)) AS final, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('seen ', CAST(l_partkey AS VARCHAR(20))) END AS observed FROM """ + LINES + """ l""",
    "jobs_ev": """SELECT user_id AS job_id, event_id AS id, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' WHEN 5 THEN 'running' ELSE 'cancelled' END AS status,
        CASE event_id % 9 WHEN 0 THEN 'document.started' WHEN 1 THEN 'page.processed' WHEN 2 THEN 'page.completed' WHEN 3 THEN 'page.warning' WHEN 4 THEN 'postprocess.assets' WHEN 5 THEN 'heartbeat' WHEN 6 THEN 'unit.processed' WHEN 7 THEN 'page.failed' ELSE 'job.note' END AS state,
        (event_id * 7) % 40 AS current, 40 + event_id % 3 AS total, event_id AS at FROM {events}""",
    "fragments": """SELECT o_custkey AS content_id, o_orderkey % 12 AS page_number, o_orderkey AS fragment_id, o_orderkey AS ordinal, o_orderkey % 9 <> 0 AS valid,
        ((o_orderkey * 3) % 10) / 1e2 AS top, (80 + (o_orderkey * 7) % 20) / 1e2 AS bottom, (o_orderkey % 3) / 1e2 AS b1, (o_orderkey % 2) / 1e2 AS b2, CASE o_orderkey % 8 WHEN 0 THEN 'a|b' WHEN 4 THEN '' WHEN 1 THEN 'total|amounts' ELSE 'total|amount' END AS header,
        o_orderkey % 6 <> 0 AS has_header, o_orderkey % 10 AS n_rows, concat('[', CAST(o_orderkey AS VARCHAR(20)), ']') AS rendered FROM {orders}""",
    "videos": """SELECT user_id AS video_id, event_id, (event_id * 31 % 6000) / 1e2 AS t, (event_id * 17 % 100) / 1e2 AS score, 60e0 AS duration, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 12e0 END AS frame_rate FROM {events}""",
    "units": """SELECT o_custkey AS content_id, o_orderkey % 60 + 1 AS unit, 60 AS total FROM {orders}""",
    "uploads": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/tiff' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS mime,
        CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '1-3, 5' WHEN 3 THEN '3-1' ELSE '2,,4' END AS value, n_chars * 10000 AS size, doc_id % 15 AS units, CASE WHEN doc_id % 20 = 0 THEN 'async' ELSE 'auto' END AS mode FROM {documents}""",
    "assets": """SELECT doc_id AS ord, text AS content, source AS location, n_chars AS size FROM {documents}""",
}


#: The same blocks where they are keys.
INPUTS["blocks_once"] = INPUTS["blocks"].replace("FROM {lineitem}", f"FROM {LINES} l")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    return spark.sql(INPUTS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def cte(*names: str) -> str:
    """The same inputs as a WITH clause."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({INPUTS[n].format(**{t: t for t in TABLES})})" for n in names)
