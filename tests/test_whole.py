"""Registered queries take whole texts and whole tables, not a part of them."""

from __future__ import annotations

import difflib
import random

from quirelake.plans import registry


def test_seq_ratio_takes_whole_texts(spark, tmp_path):
    rng = random.Random(11)
    head = "one opening that both of two documents share, longer than sixty characters by far, " * 2
    texts = [head + "".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (900, 700, 40)] + ["", None, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ratio"] for r in registry.queries()["seq_ratio"](spark, str(tmp_path)).collect()}
    pairs = enumerate(zip(texts[:-1], texts[1:], strict=True))
    assert got == {i: None if None in (a, b) else difflib.SequenceMatcher(None, a, b).ratio() for i, (a, b) in pairs}
    assert got[0] < 1


def test_text_rules_see_what_stands_late(spark, tmp_path):
    text = "word " * 80 + "4,217.5% on 2019 年 3 月 9 日 LAST"
    spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = {n: registry.queries()[f"{n}"](spark, str(tmp_path)).first() for n in ("compact_text", "number_tokens", "date_tokens", "header_signature")}
    assert row["number_tokens"]["tokens"].split()[:2] == ["4217.5%", "2019"]
    assert row["date_tokens"]["dates"].split() == ["2019年3月9日", "2024年2月2日"]
    assert row["header_signature"]["sig"].split("|")[81:83] == ["4,217.5%", "on"]
    assert row["compact_text"]["n"] > 320


def test_votes_compare_whole_values(spark, tmp_path):
    rows = [(1, 1, "u", "Acme Holdings of the North"), (1, 2, "u", "Acme Holdings of the South"), (1, 3, "u", "Acme Holdings of the South")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["field"]: r["value"] for r in registry.queries()["metadata_vote"](spark, str(tmp_path)).collect()}
    assert got["company_name"] == got["statement_title"] == "Acme Holdings of the South"


def test_upsert_takes_all_events_and_keeps_other_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "c", 5)], "user_id long, event_type string, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["job_upsert"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "b"), (2, "c"), (3, "old")]
