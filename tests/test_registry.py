"""Every query that SQL can express, against DuckDB on the smallest tables; the others must return rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quirelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((plain(r) for r in got.select(*columns).collect()), key=repr)
    if name not in registry.oracle_sql():
        assert rows
        return
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert rows == sorted((plain(r) for r in want.project(",".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_plain_lines_keep_what_stands(spark, tmp_path):
    """Final line breaks, other breaks and spaces, and texts that are missing."""
    texts = ["a line of a text.\nand more", "x" * 19 + "\nand more", "a\n", "a\n\n", "\n", "a\n| b |\n", "a\r\n| b |\r\nc", "a\r| b |", "\u3000| b\n\xa0<!-- c\n\t| d", "a\u2028| b", "| a", "", None]
    rows = [(17 * i + k, t, "en", "s", len(t or "")) for i, t in enumerate(texts) for k in ((3, 6, 7) if t is not None else (7,))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["plain_lines"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["plain_lines"]).fetchall())
    assert len(got) == len(rows) - 1


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["content_id", "trusted_pages", "degraded_pages", "untrusted_pages", "failed_pages", "acceptable", "repaired_pages", "visual_pages", "calls", "resolved_conflicts", "unresolved_conflicts"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
