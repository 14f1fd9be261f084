"""Physical plans: no join without an equi key, narrow scans, predicates at the scan."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quirelake.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_joins_have_keys(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.queries()[name](spark, SF)))


def test_scans_are_narrow(spark):
    text = plan(registry.queries()["page_source_kind"](spark, SF))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,n_chars:bigint>", text)
    text = plan(registry.queries()["jobs_expired"](spark, SF).where(F.col("job_id") > 5))
    assert "LessThanOrEqual(o_orderdate" in text


def test_a_tables_rows_are_folded_once(spark):
    assert len(set(re.findall(r"ArrowEvalPython \(\d+\)", plan(registry.queries()["fused_tables"](spark, SF))))) == 1


def test_no_python_but_where_it_is_named(spark):
    named = {"seq_ratio", "row_label_match", "replay_trim", "overlap_dedup", "continuation_repair", "html_tables", "safe_filename", "cross_page_link", "merged_rows", "logical_tables", "md_to_text",
             "text_normalize", "split_headings", "glyph_map", "source_url", "office_safety", "office_images",
             "band_combine", "attached_evidence", "supplement_rows", "line_groups", "grid_anchor", "heading_between", "document_rendering", "native_order_repair", "prepared_pages", "signature_pages", "fused_tables", "char_multiset_coverage"}
    python = {n for n, q in registry.queries().items() if re.search("Python|Pandas|Arrow", plan(q(spark, SF)))}
    assert python == named
