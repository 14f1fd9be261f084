"""The fusion of one table as a fold: what a model read in bands, completed and checked by other sources.

All steps have the key of a table, so a table's rows are gathered once, and an Arrow UDF takes many tables a batch. The steps are those of
``visual`` (bands, added rows, labels), ``fuzzy`` (replays, overlaps), ``fusion`` (votes) and ``tables`` (Markdown)."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators import fuzzy, visual
from quirelake.operators.fusion import FINAL, FIRST
from quirelake.operators.fuzzy import plain

TABLES = "array<struct<markdown:string,parsed:bigint,agreed:bigint,conflicts:bigint,qwen_only:bigint>>"
CELLS = "array<struct<row_index:bigint,col:int,value:string,added:boolean,final:string,consistent:boolean,conflict:boolean,qwen_only:boolean>>"
_ESCAPED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "|": "&#124;"})


def gathered(extractions: DataFrame, sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row a table, with all rows of the bands (of = 0) and of the sources (of = 1 and on)."""
    band = [F.lit(0).alias("of"), F.col("band").cast("long").alias("band"), F.col("row_index").cast("long").alias("row_index"), "columns", "kind", F.lit(None).cast("boolean").alias("has_header"), "cells"]
    rows = extractions.select(*keys, *band)
    for i, source in enumerate(sources.values(), 1):
        own = [F.lit(i).alias("of"), F.lit(None).cast("long").alias("band"), F.col("row_index").cast("long").alias("row_index"), F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("string").alias("kind"), "has_header", "cells"]
        rows = rows.unionByName(source.select(*keys, *own))
    rows = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("of", "band", "row_index", "columns", "kind", "has_header", "cells")).alias("__rows"))


def _groups(rows: pa.ListArray) -> Iterator[list[tuple]]:
    """(of, band, row_index, columns, kind, has_header, cells) of each table; arrays are read flat, some hundred tables at a time."""

    def lists(x: pa.ListArray) -> list[list]:
        ends = x.offsets.to_pylist()
        values = x.values[ends[0] : ends[-1]].to_pylist()
        return [values[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]

    names = ("of", "band", "row_index", "columns", "kind", "has_header", "cells")
    for start in range(0, len(rows), 256):
        ends = rows[start : start + 256].offsets.to_pylist()
        part = rows.values[ends[0] : ends[-1]]
        fields = [part.field(n) for n in names]
        flat = list(zip(*(lists(x) if pa.types.is_list(x.type) else x.to_pylist() for x in fields), strict=True))
        yield from (flat[a - ends[0] : b - ends[0]] for a, b in pairwise(ends))


def _in_order(rows: list[tuple]) -> list[tuple]:
    """By band and row index, then by cells; nulls first."""
    place = lambda r: tuple(float("-inf") if x is None else x for x in r[1:3])
    if len({r[1:3] for r in rows}) == len(rows):
        return sorted(rows, key=place)
    return sorted(rows, key=lambda r: (place(r), [(c is not None, c or "") for c in r[6]]))


def combined(rows: list[tuple]) -> tuple[list[str], list[list[str]]]:
    """The columns of a table and its rows over all bands, as ``visual.band_combine`` has them."""
    rows = _in_order(rows)
    columns = next((r[3] for r in rows if r[3]), None)
    if columns is None:
        return [], []
    width = len(columns)
    kept = {rows[i][1:3] for i in fuzzy.kept_after_replay([{"band": r[1], "cells": r[6]} for r in rows])}
    names, seen, out = [n for n in map(plain, columns) if n], set(), []
    for r in rows:
        if r[1] is None or r[2] is None or r[1:3] not in kept:
            continue
        cells = [c or "" for c in r[6][:width]] + [""] * (width - len(r[6]))
        norms = list(map(plain, cells))
        filled = [c for c in norms if c]
        if r[4] in ("header", None) and filled and all(any(c in n for n in names) for c in filled):
            continue
        sign = "|".join(norms)
        if sign in seen and sign.replace("|", ""):
            continue
        seen.add(sign)
        out.append(cells)
    return columns, out


def completed(table: list[list[str]], source: list[tuple], before: list[bool]) -> tuple[list[list[str]], list[bool]]:
    """With the rows that a source has alone; a row that was added before stays so, wherever it stands by now."""
    known = {tuple(r) for r, a in zip(table, before, strict=True) if a}
    got = visual.supplemented(table, [r[6] for r in source if r[5] is False or (r[2] or 0) > 0], len(table[0]))
    return [r for r, _ in got], [a or (bool(known) and tuple(r) in known) for r, a in got]


def vote(heard: list[tuple[str, str | None]]) -> tuple[int, int, str, bool, bool, bool]:
    """(whether two agree, values present, final, consistent, conflict, qwen_only) of a cell, as ``fusion.field_consensus`` and
    ``fusion.evidence_strength`` have it."""
    values = [v for _, v in heard]
    if len(values) > 1 and values.count(values[0]) == len(values) and plain(values[0]):
        return 1, len(values), values[0], True, False, False
    groups: dict[str, list[tuple[int, int, str]]] = {}
    raw = None
    for source, value in heard:
        if not value:
            continue
        first = FIRST.index(source)
        if raw is None or (first, value) < raw:
            raw = (first, value)
        norm = plain(value)
        if norm:
            groups.setdefault(norm, []).append((FINAL.index(source), first, value))
    agreed = min(((min(f for _, f, _ in g), min(g)[2]) for g in groups.values() if len(g) > 1), default=None)
    if agreed:
        return 1, sum(map(len, groups.values())), agreed[1], True, False, False
    own = bool(groups) and all(f == 0 for g in groups.values() for _, f, _ in g)
    return 0, len(groups), raw[1] if raw else "", False, len(groups) > 1, own


def fused(rows: list[tuple], names: list[str]) -> tuple[list[str], list[list[tuple]]] | None:
    """The columns of a table, and (row_index, col, value, added, final, consistent, conflict, qwen_only) of its rows; none if it has none."""
    parts: list[list[tuple]] = [[] for _ in range(len(names) + 1)]
    for r in rows:
        parts[r[0]].append(r)
    columns, table = combined(parts[0])
    if not table:
        return None
    sources = [_in_order(p) for p in parts[1:]]
    added = [False] * len(table)
    for source in sources:
        table, added = completed(table, source, added)
    width = len(table[0])
    heard: list[list[list[tuple]]] = [[[] if a else [("qwen", v)] for v in row] for row, a in zip(table, added, strict=True)]
    for name, source in zip(names, sources, strict=True):
        if name not in FIRST:
            continue
        by_index: dict[int, list[list]] = {}
        for r in source:
            if r[2] is not None:
                by_index.setdefault(r[2], []).append(r[6])
        labels = fuzzy.Labels([(plain(r[6][0]) if r[6] else "", r[2]) for r in source if (r[2] or 0) > 0])
        for row, cells in zip(table, heard, strict=True):
            at = labels.of(plain(row[0]), 0.86)
            for theirs in by_index[at] if at is not None else ():
                for to, value in zip(cells, theirs[:width], strict=False):
                    to.append((name, value))
    votes = [[vote(h) for h in cells] for cells in heard]
    ranked = [{"cells": row, "strength": sum([1000 * v[0] + v[1] for v in vs])} for row, vs in zip(table, votes, strict=True)]
    out = []
    for i in sorted(fuzzy.kept_of_overlap(ranked)):
        # a cell that no source speaks for keeps what the row has
        out.append([(i, col, value, added[i], v[2] or value or "", *(v[3:] if h else (None, None, None))) for col, (value, v, h) in enumerate(zip(table[i], votes[i], heard[i], strict=True))])
    return columns, out


def markdown(rows: list[list[str | None]]) -> str:
    """As ``tables.gfm_render`` has it; the first row is the header."""
    lines = ["| " + " | ".join([(c or "").replace("\n", " ").strip().translate(_ESCAPED) for c in r]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]])


def _column(kind: str, names: list[str], build: Callable[[Iterator], pa.Array], rows: str) -> Column:
    @F.arrow_udf(kind)
    def fold(groups: pa.Array) -> pa.Array:
        # a table leaves no cycles, and looking for some takes a good part of the time
        collects = gc.isenabled()
        gc.disable()
        try:
            return build(fused(g, names) for g in _groups(groups))
        finally:
            if collects:
                gc.enable()

    return fold(rows)


def _tables(found: Iterator) -> pa.Array:
    ends, shown, counts = [0], [], ([], [], [], [])
    for f in found:
        if f:
            columns, rows = f
            shown.append(markdown([columns, *([c[4] for c in row] for row in rows)]))
            counts[0].append(len(columns) * len(rows))
            for i in (1, 2, 3):
                counts[i].append([c[i + 4] for row in rows for c in row].count(True))
        ends.append(len(shown))
    fields = [pa.array(shown, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["markdown", "parsed", "agreed", "conflicts", "qwen_only"]))


def _cells(found: Iterator) -> pa.Array:
    types = {"row_index": pa.int64(), "col": pa.int32(), "value": pa.string(), "added": pa.bool_(), "final": pa.string(), "consistent": pa.bool_(), "conflict": pa.bool_(), "qwen_only": pa.bool_()}
    kind = pa.list_(pa.struct(list(types.items())))
    return pa.array([[dict(zip(types, c, strict=True)) for row in f[1] for c in row] if f else [] for f in found], kind)


def tables(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, markdown, parsed, agreed, conflicts, qwen_only) from gathered rows."""
    return rows.select(*keys, F.explode(_column(TABLES, names, _tables, "__rows")).alias("__t")).select(*keys, "__t.*")


def cells(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, row_index, col, value, added, final, consistent, conflict, qwen_only) from gathered rows."""
    return rows.select(*keys, F.explode(_column(CELLS, names, _cells, "__rows")).alias("__c")).select(*keys, "__c.*")
