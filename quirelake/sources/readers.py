"""Readers: bytes, layouts, tables in HTML and Markdown, event frames, manifests. Perception back ends are
sources too: anything that yields evidence tables of these shapes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T


def binary_sources(spark: SparkSession, path: str, cap: int = 200 * 1024 * 1024) -> DataFrame:
    """Files as (path, length, content, sha256, mime); those over the cap are marked and not hashed."""
    rows = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= cap
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return rows.select("path", "length", F.when(small, F.col("content")).alias("content"), F.when(small, F.sha2("content", 256)).alias("sha256"), mime_type(F.hex(F.substring("content", 1, 64)), suffix).alias("mime"), F.when(~small, "too_large").alias("error"))


def mime_type(head: Column, suffix: Column) -> Column:
    """Type by the first bytes, as upper-case hex; the suffix decides between relatives only."""
    at = lambda x, p: F.substring(head, 2 * p + 1, len(x)) == x
    starts = lambda *xs: F.coalesce(*[F.when(head.startswith(x), True) for x in xs], F.lit(False))
    return (
        F.when(starts("255044462D"), "application/pdf")
        .when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "image/tiff")
        .when(starts("424D"), "image/bmp")
        .when(starts("52494646") & at("57454250", 8), "image/webp")
        .when(starts("52494646") & at("41564920", 8), "video/x-msvideo")
        .when(at("66747970", 4), F.when((suffix == ".mov") | head.contains("71742020"), "video/quicktime").otherwise("video/mp4"))
        .when(starts("1A45DFA3"), F.when((suffix == ".webm") | head.contains("7765626D"), "video/webm").otherwise("video/x-matroska"))
    )


_REGION = "array<struct<index:int,label:string,native_label:string,content:string,bbox_2d:array<double>>>"


def layout_regions(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Regions of a layout in JSON, or one row with an error. Boxes are in thousandths of the page."""
    parsed = rows.select(key, F.from_json(payload, _REGION).alias("r"))
    bad = F.when(F.col("r").isNull(), "invalid_json").when(F.exists("r", lambda x: x["label"].isNull() | (F.trim(x["label"]) == "")), "no_label")
    box = lambda x: x["bbox_2d"]
    wrong = F.exists("r", lambda x: box(x).isNotNull() & ((F.size(box(x)) != 4) | F.exists(box(x), lambda v: v.isNull() | (v < 0) | (v > 1000)) | (box(x)[0] > box(x)[2]) | (box(x)[1] > box(x)[3])))
    parsed = parsed.withColumn("error", F.coalesce(bad, F.when(wrong, "invalid_box")))
    good = parsed.where("error is null").select(key, F.posexplode("r").alias("pos", "x"))
    good = good.select(key, F.when(F.col("x.index") >= 0, F.col("x.index")).otherwise(F.col("pos")).alias("index"), T.fold(F.trim("x.label")).alias("label"), F.coalesce("x.content", F.lit("")).alias("content"), F.col("x.bbox_2d").alias("bbox"), F.lit(None).cast("string").alias("error"))
    failed = parsed.where("error is not null").select(key, F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<double>").alias("bbox"), "error")
    return good.unionByName(failed)


def markdown_rows(content: Column) -> Column:
    """Rows of a Markdown table as arrays of cells, padded; escaped pipes are text, the rule line is left out. Null for less than two
    lines, and beyond 100 columns or 2,000 rows."""
    rows = F.filter(F.transform(T.lines(content), lambda l: F.trim(l)), lambda l: l.startswith("|"))
    cells = F.transform(rows, lambda l: F.transform(F.split(F.regexp_replace(l, r"^\|+|(?<!\\)\|+$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))))
    rule = lambda row, i: (i == 1) & F.forall(row, lambda c: c.rlike(r"^:?-{3,}:?$"))
    body = F.filter(cells, lambda row, i: ~rule(row, i))
    wide = F.array_max(F.transform(body, lambda r: F.size(r)))
    return F.when((F.size(rows) >= 2) & (wide <= 100) & (F.size(body) <= 2000), F.transform(body, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r)))))


_TAG = re.compile(r"""(?s)<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""")
_SPAN = re.compile(r"""(?i)\b(rowspan|colspan)\s*=\s*["']?\s*(-?\d+)""")


def _spans(attributes: str, most: int = 2000) -> tuple[int, int]:
    found = {k.lower(): min(max(int(v), 1), most) for k, v in reversed(_SPAN.findall(attributes))}
    return found.get("rowspan", 1), found.get("colspan", 1)


def html_cells(content: str | None) -> list[list[list[tuple[str, int, int, bool]]]]:
    """The tables of a text: rows of (text, rows down, columns across, header). Tables inside cells are tables of their own;
    rows outside any table make one."""
    text, tables, at = content or "", [], 0
    open_: list[dict] = []  # tables that are being read, the innermost last

    def table() -> dict:
        if not open_:
            open_.append({"rows": [], "row": None, "cell": None})
            tables.append(open_[0]["rows"])
        return open_[-1]

    def say(part: str) -> None:
        if open_ and open_[-1]["cell"]:
            open_[-1]["cell"][1].append(part)

    for m in _TAG.finditer(text):
        say(html.unescape(text[at : m.start()]))
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if name == "table":
            if closing:
                open_ = open_[:-1]
            else:
                open_.append({"rows": [], "row": None, "cell": None})
                tables.append(open_[-1]["rows"])
        elif name == "tr":
            t = table()
            if closing and t["row"]:
                t["rows"].append(t["row"])
            t["row"], t["cell"] = (None if closing else []), (t["cell"] if closing else None)
        elif name in ("td", "th") and open_ and open_[-1]["row"] is not None:
            t = open_[-1]
            if not closing:
                t["cell"] = (name, [], *_spans(m[3]))
            elif t["cell"] and t["cell"][0] == name:
                t["row"].append((" ".join("".join(t["cell"][1]).split()), *t["cell"][2:], name == "th"))
                t["cell"] = None
        elif name == "br" and not closing:
            say("\n")
    return [rows for rows in tables if rows]


def placed(rows: list[list[tuple[str, int, int, bool]]], most_rows: int = 2000, most_columns: int = 100) -> list[tuple[int, int, str, bool]]:
    """(row, column, text, header) of a table's grid; covered places are blank, a table beyond the bounds is empty."""
    if len(rows) > most_rows:
        return []
    until: list[int] = []  # by column: the row up to which it is taken
    cells: dict[tuple[int, int], tuple[str, bool]] = {}
    deep = 0
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, head in row:
            while c < len(until) and until[c] > r:
                c += 1
            if c + across > most_columns or r + down > most_rows:
                return []
            until += [0] * (c + across - len(until))
            until[c : c + across] = [max(r + down, x) for x in until[c : c + across]]
            cells[r, c] = (text, head)
            deep, c = max(deep, r + down), c + across
    return [(y, x, *cells.get((y, x), ("", False))) for y in range(deep) for x in range(len(until))]


def html_grid(content: str | None) -> list[tuple[int, int, int, str, bool]]:
    """(table, row, column, text, header) of all tables of a text."""
    return [(t, *cell) for t, rows in enumerate(html_cells(content)) for cell in placed(rows)]


def html_tables(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Grid cells (key, table_index, row, col, text, header) of HTML tables."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *cell) for k, h in zip(pdf[key], pdf[payload], strict=True) for cell in html_grid(h)]
            yield pd.DataFrame(out, columns=[key, "table_index", "row", "col", "text", "header"])

    return rows.select(key, payload).mapInPandas(run, f"{key} {kind}, table_index long, row long, col long, text string, header boolean")


def sse_frames(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Event frames of a text stream: fields up to a blank line; data lines are joined, comments are ignored."""
    w = Window.partitionBy(key).orderBy(order)
    text = F.regexp_replace(line, r"\r$", "")
    rows = lines.withColumn("text", text).withColumn("blank", F.col("text") == "")
    rows = rows.withColumn("frame", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(w) - F.when(F.col("blank"), 1).otherwise(0))
    name, value = F.regexp_extract("text", r"^([^:]*)", 1), F.regexp_replace(F.regexp_extract("text", r"^[^:]*:?(.*)$", 1), "^ ", "")
    rows = rows.where(~F.col("blank") & ~F.col("text").startswith(":")).withColumn("name", name).withColumn("value", value)
    data = F.array_sort(F.collect_list(F.when(F.col("name") == "data", F.struct(F.col(order).alias("o"), F.col("value").alias("v")))))
    got = rows.groupBy(key, "frame").agg(F.max_by(F.when(F.col("name") == "id", F.col("value")), F.when(F.col("name") == "id", F.col(order))).alias("id"), F.max_by(F.when(F.col("name") == "event", F.col("value")), F.when(F.col("name") == "event", F.col(order))).alias("event"), F.array_join(F.transform(data, lambda d: d["v"]), "\n").alias("data"))
    return got.where("data <> ''").select(key, "frame", "id", F.coalesce("event", F.lit("message")).alias("event"), "data")


def video_probe(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Duration, size, codec and frame rate from a probe's JSON."""
    p = F.from_json(payload, "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string>>>")
    rows = rows.select(key, p.alias("p")).withColumn("v", F.filter("p.streams", lambda s: s["codec_type"] == "video")[0])
    up, down = F.split_part("v.avg_frame_rate", F.lit("/"), F.lit(1)).try_cast("double"), F.split_part("v.avg_frame_rate", F.lit("/"), F.lit(2)).try_cast("double")
    return rows.select(key, F.floor(F.col("p.format.duration").try_cast("double") * 1000).cast("long").alias("duration_ms"), F.col("v.width").cast("long").alias("width"), F.col("v.height").cast("long").alias("height"), F.col("v.codec_name").alias("codec"), (up / F.nullif(down, F.lit(0.0))).alias("frame_rate"))


def gated_results(rows: DataFrame, key: str, payload: str, version: str = "content-parse-result/1.0") -> DataFrame:
    """Stored results of the supported version; others are errors, never converted."""
    got = rows.select(key, F.from_json(payload, "struct<schema_version:string,content_id:string,status:string>").alias("r"))
    return got.select(key, F.when(F.col("r").isNull(), "invalid").when(F.coalesce(F.col("r.schema_version"), F.lit("")) != version, "unsupported_version").alias("error"), "r.content_id", "r.status")


def manifest(spark: SparkSession, path: str, cases: list[str] | None = None) -> DataFrame:
    """Cases of a quality manifest of version 2; of the cases asked for, those that it does not have have an error."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.where("version = 2").select(F.explode("cases").alias("c")).select("c.*")
    if cases is None:
        return rows.withColumn("error", F.lit(None).cast("string"))
    wanted = spark.createDataFrame([(c,) for c in cases], "id string")
    return wanted.join(rows.withColumn("__known", F.lit(True)), "id", "left").withColumn("error", F.when(F.col("__known").isNull(), "unknown_case")).drop("__known")


def decoded_record(text: Column, fields: list[str]) -> tuple[Column, Column]:
    """(options, whether the record is of an older form) of a stored job: an old name is replaced, unknown options go."""
    options = F.from_json(F.get_json_object(text, "$.options"), "map<string,string>")
    names = F.map_keys(options)
    renamed = F.transform_keys(options, lambda k, _: F.when(k == "page_range", "unit_range").otherwise(k))
    unknown = F.exists(names, lambda k: ~k.isin("page_range", *fields))
    old = F.array_contains(names, "page_range") | unknown | (F.coalesce(F.get_json_object(text, "$.object"), F.lit("")) != "content.parse.job")
    return F.map_filter(renamed, lambda k, _: k.isin(*fields)), F.coalesce(old, F.lit(True))
