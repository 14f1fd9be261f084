"""Tables read from pictures: bands, their layout, rows that sources add, and lines that repeat.

What compares labels by ratio, or walks rows in order, is a fold over one table; the rest is joins and expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from quirelake.functions import text as T
from quirelake.functions.pyfuncs import bounded_ratio
from quirelake.operators import fuzzy
from quirelake.operators.fuzzy import plain


# ---- bands and layout


def band_plan(lines: DataFrame, most_calls: int = 3) -> DataFrame:
    """From (keys…, row_lines, column_lines, calls): bands of about twenty rows within the calls left, of which a dense page keeps one for
    conflicts if it has three; dense and wide pages hold two tables side by side."""
    wanted = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.col("row_lines") - 1) / 20))
    left = F.greatest(F.lit(1), F.lit(most_calls) - F.col("calls"))
    reserved = F.when((wanted > 1) & (left >= 3), 1).otherwise(0)
    return lines.withColumn("bands", F.least(F.greatest(F.lit(1), left - reserved), wanted).cast("long")).withColumn("parallel", (F.col("row_lines") >= 20) & (F.col("column_lines") >= 8))


def band_edges(plan: DataFrame, height: str = "height", share: float = 0.015) -> DataFrame:
    """One row a band: its first and last pixel row, with some overlap with its neighbours."""
    over = F.greatest(F.lit(2), F.bround(F.col(height) * share).cast("long"))
    rows = plan.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)))
    top = F.greatest(F.lit(0).cast("long"), F.floor(F.col(height) * F.col("band") / F.col("bands")) - over)
    bottom = F.least(F.col(height).cast("long"), F.ceil(F.col(height) * (F.col("band") + 1) / F.col("bands")) + over)
    return rows.withColumn("top", top).withColumn("bottom", bottom)


def layout_contract(tables: DataFrame, key: str) -> DataFrame:
    """From (key, band, table_id, columns): later bands must have the tables of the first one, as wide; they take its columns.
    A band that breaks this has an error in all its rows."""
    rows = tables.withColumn("first", F.min("band").over(Window.partitionBy(key)))
    locked = rows.where("band = first").select(key, "table_id", F.col("columns").alias("locked"))
    ids = locked.groupBy(key).agg(F.array_sort(F.collect_set("table_id")).alias("ids"))
    own = rows.groupBy(key, "band").agg(F.array_sort(F.collect_set("table_id")).alias("own"))
    rows = rows.drop("first").join(locked, [key, "table_id"], "left").join(own, [key, "band"]).join(ids, key)
    wide = F.max(F.size("columns") != F.coalesce(F.size("locked"), F.lit(-1))).over(Window.partitionBy(key, "band"))
    error = F.when(F.col("own") != F.col("ids"), "table_ids").when(wide, "column_width")
    return rows.withColumn("error", error).withColumn("columns", F.when(F.col("error").isNull(), F.col("locked")).otherwise(F.col("columns"))).drop("locked", "own", "ids")


def table_place(table_id: Column) -> Column:
    """Tables from left to right."""
    return F.when(table_id == "left", 0).when(table_id == "right", 100).when(table_id == "single", 1).otherwise(F.regexp_extract(table_id, r"^single_([0-9]+)$", 1).try_cast("int") + 1)


def band_combine(rows: DataFrame, key: str) -> DataFrame:
    """From (key, band, table_id, columns, row_index, kind, cells): the rows of each table over all bands, in order. The columns
    are the first that are not empty; rows are cut or padded to them; replayed rows, header rows that say what the columns
    say, and exact repeats of a row that is not empty go."""
    one = [key, "table_id"]
    columns = rows.where(F.size("columns") > 0).groupBy(*one).agg(F.min_by("columns", "band").alias("of"))
    kept = fuzzy.replay_trim(rows.select(*one, "band", "row_index", "cells"), one).select(*one, "band", "row_index")
    rows = rows.join(kept, [*one, "band", "row_index"], "left_semi").join(columns, one)
    cells = T.row_values(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), F.size("of"))
    rows = rows.withColumn("cells", cells).where(~((F.col("kind") == "header") & T.redundant_header(F.col("of"), F.col("cells"))))
    rows = rows.withColumn("sign", F.array_join(F.transform("cells", T.normalized), "|"))
    again = F.row_number().over(Window.partitionBy(*one, "sign").orderBy("band", "row_index"))
    rows = rows.withColumn("again", again).where((F.col("again") == 1) | (F.replace("sign", F.lit("|"), F.lit("")) == ""))
    out = F.row_number().over(Window.partitionBy(*one).orderBy("band", "row_index")) - 1
    return rows.select(*one, table_place(F.col("table_id")).alias("place"), out.alias("out_index"), F.col("of").alias("columns"), "cells")


#: What a model answers for a band (the shape, and below the limits, are fixed values).
ANSWER = "struct<company_name:string,statement_title:string,statement_date:string,unit:string,tables:array<struct<table_id:string,section_name:string,title:string,unit:string,columns:array<string>,rows:array<struct<kind:string,cells:array<string>>>>>>"
MOST_COLUMNS, MOST_ROWS, MOST_TABLES, LABELLED = 24, 36, 4, 0.9


def answer_error(answer: Column, parallel: Column) -> Column:
    """The first rule that a band's answer breaks: its form, names and sizes of tables, widths of rows, labels of data rows, and whether
    tables stand below or beside each other. parallel: exactly a left and a right table are asked for."""
    tables = answer["tables"]
    ids = F.transform(tables, lambda t: t["table_id"])
    total = lambda r: F.exists(F.slice(r["cells"], 1, 3), lambda c: F.coalesce(c, F.lit("")).rlike("(?:合计|总计)$"))
    data = lambda t: F.filter(t["rows"], lambda r: (r["kind"] == "data") & ~total(r))
    named = lambda t: F.size(F.filter(data(t), lambda r: T.normalized(r["cells"][0]) != ""))
    rules = {
        "invalid_json": answer.isNull() | tables.isNull(),
        "too_many_tables": F.size(tables) > MOST_TABLES,
        "table_id": F.exists(ids, lambda i: ~F.coalesce(i, F.lit("")).rlike(r"^(?:single(?:_[1-4])?|left|right)$")),
        "columns": F.exists(tables, lambda t: ~F.coalesce(F.size(t["columns"]), F.lit(0)).between(1, MOST_COLUMNS)),
        "rows": F.exists(tables, lambda t: ~F.coalesce(F.size(t["rows"]), F.lit(0)).between(1, MOST_ROWS)),
        "row_kind": F.exists(tables, lambda t: F.exists(t["rows"], lambda r: ~F.coalesce(r["kind"], F.lit("")).isin("header", "section", "data"))),
        "row_width": F.exists(tables, lambda t: F.exists(t["rows"], lambda r: F.size(r["cells"]) != F.size(t["columns"]))),
        "row_labels": F.exists(tables, lambda t: (F.size(data(t)) > 0) & (named(t) / F.size(data(t)) < LABELLED)),
        "repeated_ids": F.size(F.array_distinct(ids)) != F.size(ids),
        "mixed_ids": F.exists(ids, lambda i: i.startswith("single")) & F.exists(ids, lambda i: i.isin("left", "right")),
        "not_parallel": parallel & (F.array_sort(ids) != F.array(F.lit("left"), F.lit("right"))),
    }
    return F.coalesce(*(F.when(rule, name) for name, rule in rules.items()))


def band_answers(bands: DataFrame, payload: str, parallel: str) -> DataFrame:
    """Answers as tables and rows, those that break a rule as one row with its error. Keys are all other columns."""
    keys = [c for c in bands.columns if c not in (payload, parallel)]
    rows = bands.withColumn("__a", F.from_json(payload, ANSWER)).withColumn("error", answer_error(F.col("__a"), F.coalesce(parallel, F.lit(False))))
    good = rows.where("error is null").select(*keys, F.explode("__a.tables").alias("__t")).select(*keys, "__t.table_id", "__t.columns", F.posexplode("__t.rows").alias("row_index", "__r")).select(*keys, "table_id", "columns", "row_index", "__r.kind", "__r.cells", F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select(*keys, *(F.lit(None).cast(dict(good.dtypes)[c]).alias(c) for c in ("table_id", "columns", "row_index", "kind", "cells")), "error")
    return good.unionByName(bad)


# ---- rows of other sources


def attached(rows: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_index, col, value): what a source says for the cells of a table. Rows (keys, row_index, cells) find the source's row
    of their label, the first source row apart, which is its header; cells meet by their place."""
    labels = source.where("row_index > 0").select(*keys, "row_index", F.coalesce(F.col("cells")[0], F.lit("")).alias("label"))
    targets = rows.select(*keys, F.col("row_index").alias("own"), F.coalesce(F.col("cells")[0], F.lit("")).alias("target"), F.size("cells").alias("width"))
    found = fuzzy.row_label_match(targets.select(*keys, "target").distinct(), labels, keys).where("row_index is not null")
    met = targets.join(found, [*keys, "target"]).join(source.select(*keys, "row_index", F.col("cells").alias("theirs")), [*keys, "row_index"])
    cells = met.select(*keys, F.col("own").alias("row_index"), "width", F.posexplode("theirs").alias("col", "value")).where("col < width")
    return cells.select(*keys, "row_index", "col", "value")


def _private(value: str) -> bool:
    return any("\ue000" <= c <= "\uf8ff" for c in value)


def supplemented(table: list[list[str]], source: list[list[str]], width: int, cut: float = 0.86) -> list[tuple[list[str], bool]]:
    """The rows of a table with those of a source that it lacks, each with whether it was added. A row comes before the first one that
    stands for a later row of the source."""
    source = [[c or "" for c in r] for r in source]
    named = fuzzy.Labels([(plain(r[0]), i) for i, r in enumerate(source) if r])
    out = [(list(r), False) for r in table]
    labels = [plain(r[0]) if r else "" for r in table]
    # equal rows of the source stand for the first of them
    first = {tuple(r): i for i, r in reversed(list(enumerate(source)))}
    stands: dict[str, int] = {}
    for i, row in enumerate(source):
        if not row or len(row) > width:
            continue
        full = row + [""] * (width - len(row))
        if not (want := plain(full[0])) or labels.count(want) == 1 or sum(bool(plain(c)) for c in full) < 2 or any(map(_private, full)):
            continue
        if fuzzy.Labels([(x, k) for k, x in enumerate(labels)]).of(want, cut) is not None:
            continue
        for x in labels:
            if x not in stands:
                at = named.of(x, cut)
                stands[x] = -1 if at is None else first[tuple(source[at])]
        place = next((k for k, x in enumerate(labels) if stands[x] > i), len(out))
        out.insert(place, (full, True))
        labels.insert(place, want)
    return out


_ROWS = ArrayType(StructType([StructField("cells", ArrayType(StringType())), StructField("added", BooleanType())]))


def supplement_rows(tables: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_index, cells, added) from rows (keys, row_index, cells) and a source's rows (keys, row_index, cells, has_header); a
    source's header row takes no part. Tables are as wide as their first row."""

    @F.arrow_udf(_ROWS)
    def fill(own: pa.Array, theirs: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("cells", pa.list_(pa.string())), ("added", pa.bool_())]))
        out = [[{"cells": c, "added": a} for c, a in supplemented([x["cells"] for x in t], [x["cells"] for x in s or []], len(t[0]["cells"]))] for t, s in zip(own.to_pylist(), theirs.to_pylist(), strict=True)]
        return pa.array(out, kind)

    mine = fuzzy._gathered(tables, keys, ["row_index"], ["cells"], "__own")
    other = fuzzy._gathered(sources.where(~F.col("has_header") | (F.col("row_index") > 0)), keys, ["row_index"], ["cells"], "__theirs")
    got = mine.join(other, keys, "left").withColumn("__filled", fill("__own", "__theirs"))
    return got.select(*keys, F.posexplode("__filled").alias("row_index", "__row")).select(*keys, "row_index", "__row.cells", "__row.added")


# ---- lines


def deduplicated(lines: list[str], repeated: list[str], cut: float = 0.88, least: int = 6) -> list[str]:
    """Of each group of repeated lines the first stays; a line belongs to the first group that it equals or is much like."""
    groups = list(dict.fromkeys(filter(None, map(plain, repeated))))
    seen, out = set(), []
    for line in lines:
        key = plain(line)
        group = next((g for g in groups if g == key or (min(len(g), len(key)) >= least and bounded_ratio(key, g, cut) >= cut)), None)
        if group is None or group not in seen:
            out.append(line)
        seen.add(group)
    return out


@F.arrow_udf(ArrayType(StringType()))
def lines_deduplicated(lines: pa.Array, repeated: pa.Array) -> pa.Array:
    return pa.array([deduplicated(x or [], r or []) for x, r in zip(lines.to_pylist(), repeated.to_pylist(), strict=True)], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(LongType()))
def _variants(lines: pa.Array, company: pa.Array) -> pa.Array:
    """Places of lines that are like the company's name, but are not it."""
    out = []
    for own, name in zip(lines.to_pylist(), company.to_pylist(), strict=True):
        key = plain(name)
        out.append([i for i, x in enumerate(own or []) if key and (k := plain(x)) and k != key and bounded_ratio(key, k, 0.82) >= 0.82])
    return pa.array(out, pa.list_(pa.int64()))


def company_variants_dropped(pages: DataFrame, content: str = "content", company: str = "company") -> DataFrame:
    """Lines outside tables that misread the company's name go. Only lines that have its word are compared."""
    rows = pages.withColumn("__lines", T.lines(F.col(content)))
    bare = lambda line: T.strip(F.regexp_replace(line, r"(?U)^[#>*\s:：]+", ""))
    able = F.transform("__lines", lambda line: F.when(T.normalized(bare(line)).contains("公司") & ~F.ltrim(line).startswith("|"), bare(line)).otherwise(""))
    rows = rows.withColumn("__gone", _variants(able, F.coalesce(company, F.lit(""))))
    kept = F.filter("__lines", lambda line, i: ~F.array_contains("__gone", i.cast("long")))
    return rows.withColumn(content, T.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))).drop("__lines", "__gone")
