"""Vectors of text normalisation, input safety and the small rules; greedy ones against brute force."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.operators import fused, fusion, normalise, order, plumbing, recipes, tables, visual
from quirelake.sources import readers, safety, sinks

F_SHA = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_merging_words():
    rng = random.Random(1)
    known = {"ab", "abc", "cab", "bca", "ca", "abcab"}
    for _ in range(500):
        parts = [rng.choice(("a", "b", "c", "ab", "A")) for _ in range(rng.randint(1, 9))]
        want, i = [], 0
        while i < len(parts):
            j = max([j for j in range(i + 2, len(parts) + 1) if "".join(parts[i:j]).lower() in known], default=i + 1)
            want.append("".join(parts[i:j]))
            i = j
        assert normalise.merged_words(parts, known, 5) == want


def test_code_is_left_alone():
    n = normalise.Normaliser(["hello"], ["a-b"], ["中国"])
    text = "中 国 人 ， he llo `he llo 人 民` a - b\n```\n人 民 he llo\n```\n~~~\n人 民\n~~~\n人 民 （ x ）"
    assert n.markdown(text) == "中 国人，hello `he llo 人 民` a-b\n```\n人 民 he llo\n```\n~~~\n人 民\n~~~\n人民 （x）"
    assert n.markdown(None) is None
    for text in ("", "plain\n", "a\r\nb", "``x ` y`` 中 国", "```open\n中 国"):
        assert "".join(p for _, p in normalise.pieces(text)) == text


def test_recipe_of_normalisation(spark):
    identifier = "call_the_function"
    native = [(1, f"before text {identifier} and after that\n1.2 Total assets 2024\n"), (2, "x"), (3, None)]
    pages = [(1, "before text and after that\n\n# 1.2 Total 2024 assets\n"), (2, "a­ " + "b  c " * 30), (3, "人 " * 30), (4, None)]
    got = normalise.text_normalize(spark.createDataFrame(pages, "p int, content string"), spark.createDataFrame(native, "p int, native_text string"), ["p"])
    rows = {r["p"]: (r["changed"], r["codes"]) for r in got.collect()}
    assert rows[1] == (False, ["native_heading_order_mismatch", "native_identifier_missing"])
    assert rows[2] == (True, ["severe_spacing_pollution", "suspicious_unicode_glyphs"])
    assert rows[3] == (True, ["severe_spacing_pollution"])
    assert rows[4] == (False, [])
    assert normalise.identifiers_of("ab a_bcdef x") == []  # too little around it


def test_split_headings():
    text = "# 第一\n\n# 章节标题\n\ntext\n## Alpha beta\n \n##，rest\n## x\n\n## y\n\n## z"
    assert normalise.rejoined(text, ["第一章节标题", "Alpha beta，rest"]) == "# 第一章节标题\n\ntext\n## Alpha beta，rest\n## x\n\n## y\n\n## z"
    assert normalise.rejoined(text, ["第一章节标题"] * 2).startswith("# 第一\n")


def test_glyphs_by_matching(spark):
    assert normalise.one_to_one("a⼀b\ue000c", "a一bXc") == {"⼀": "一", "\ue000": "X"}
    assert normalise.one_to_one("ab", "cd") == {}
    got = one(spark, normalise.glyphs_replaced(F.lit("⼀x⼀"), F.create_map(F.lit("⼀"), F.lit("一"))))
    assert got[0] == "一x一"


@pytest.mark.parametrize(
    ("url", "error"),
    [
        ("https://example.com/a?b#c", None), ("", "invalid_source_url"), (None, "invalid_source_url"), ("ftp://example.com", "invalid_source_url_scheme"), ("http://", "invalid_source_url"),
        ("http://u:p@example.com", "source_url_credentials_forbidden"), ("http://localhost", "source_url_blocked"), ("http://x.localhost./", "source_url_blocked"), ("http://METADATA.google.internal/", "source_url_blocked"),
        ("http://127.0.0.1", "source_url_blocked"), ("http://169.254.169.254/x", "source_url_blocked"), ("http://100.100.100.200", "source_url_blocked"), ("http://[::1]/", "source_url_blocked"), ("http://10.0.0.5", "source_url_blocked"),
        ("http://8.8.8.8:99999", "invalid_source_url"), ("http://8.8.8.8:80", None),
    ],
)
def test_source_urls(url, error):
    assert safety.checked_url(url)["error"] == error


def test_source_urls_by_answers():
    assert safety.checked_url("http://a.example", ["93.184.216.34"])["url"] == "http://a.example/"
    assert safety.checked_url("http://a.example", ["93.184.216.34", "10.0.0.1"])["error"] == "source_url_blocked"
    assert safety.checked_url("http://a.example", ["10.0.0.1"], private_too=True)["error"] is None
    assert safety.checked_url("http://a.example", [])["error"] == "source_url_dns_failed"


def archive(**entries) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return buffer.getvalue()


def test_archives(spark):
    types = "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.{}.main+xml'/></Types>"
    word, slides = types.format("wordprocessingml.document"), types.format("presentationml.presentation")
    rel = "<R><Relationship Id='r' Type='x/image' Target='{}' TargetMode='{}'/></R>"
    cases = {
        "ok": ({"[Content_Types].xml": word, "word__document.xml": "<x/>", "word___rels__document.xml.rels": rel.format("media/a.png", "")}, (None, 1)),
        "slides": ({"[Content_Types].xml": slides, "ppt__presentation.xml": "<x/>", "ppt__slides__slide1.xml": "", "ppt__slides__slide2.xml": "", "ppt__slides__slideX.xml": ""}, (None, 2)),
        "empty": ({"[Content_Types].xml": slides, "ppt__presentation.xml": "<x/>"}, ("empty_document", None)),
        "no types": ({"word__document.xml": "<x/>"}, ("invalid_ooxml", None)),
        "other": ({"[Content_Types].xml": "<Types/>"}, ("archive_not_supported", None)),
        "outside": ({"[Content_Types].xml": word, "..__x": ""}, ("archive_path_traversal", None)),
        "absolute": ({"[Content_Types].xml": word, "__x": ""}, ("archive_path_traversal", None)),
        "bomb": ({"[Content_Types].xml": word, "big": b"\0" * (2 << 20)}, ("archive_suspicious_ratio", None)),
        "external": ({"[Content_Types].xml": word, "word__document.xml": "<x/>", "word___rels__document.xml.rels": rel.format("http://x", "External")}, ("ooxml_external_relationship", None)),
        "escaped": ({"[Content_Types].xml": word, "word__document.xml": "<x/>", "word___rels__document.xml.rels": rel.format("..%252f..%252fx", "")}, ("archive_path_traversal", None)),
    }
    files = spark.createDataFrame([(k, bytearray(archive(**v[0]))) for k, v in cases.items()] + [("none", bytearray(b"x"))], "k string, content binary")
    got = {r["k"]: (r["error"], r["units"]) for r in safety.office_errors(files, "k", "content").collect()}
    assert got == {k: v[1] for k, v in cases.items()} | {"none": ("invalid_ooxml", None)}
    many = spark.createDataFrame([("m", i, f"n{i}", 1, 1, False) for i in range(10_001)], "k string, ord long, name string, size long, packed long, encrypted boolean")
    assert safety.archive_errors(many, "k").first()["error"] == "archive_too_many_entries"
    locked = spark.createDataFrame([("m", 0, "a", 60 << 20, 60 << 20, True), ("n", 0, "a", 60 << 20, 60 << 20, False)], "k string, ord long, name string, size long, packed long, encrypted boolean")
    assert {r["k"]: r["error"] for r in safety.archive_errors(locked, "k").collect()} == {"m": "archive_encrypted_entry", "n": "archive_entry_too_large"}


def test_small_rules(spark):
    assert one(spark, plumbing.progress_percent(F.lit(1), F.lit(3)), plumbing.progress_percent(F.lit(7), F.lit(3)), plumbing.progress_percent(F.lit(7), F.lit(0)))[:] == (33.3, 100.0, 0.0)
    assert [one(spark, plumbing.reconnect_delay(F.lit(n)))[0] for n in (-1, 0, 2, 9, 99)] == [750, 750, 3000, 15000, 15000]
    assert one(spark, plumbing.ulid("job", F.lit(0).cast("long"), F.lit("f" * 20)))[0] == "job_" + "0" * 10 + "Z" * 16
    names = [("inline; filename=\"a b.pdf\"", "http://h/x"), (None, "http://h/x/y%20z.pdf?q"), (None, "http://h"), (None, "http://h/"), ("", "http://h/a+b")]
    got = spark.createDataFrame(names, "d string, u string").select(plumbing.download_filename(F.col("d"), F.col("u")).alias("n")).collect()
    assert [r["n"] for r in got] == ["a b.pdf", "y z.pdf", "document", "document", "a+b"]
    box = G.box(*(F.lit(v) for v in (0.0, 0.1, 0.5, 0.995)))
    assert one(spark, plumbing.crop_box(box, F.lit(1000), F.lit(100)))[0][:] == (0, 10, 500, 100)
    assert one(spark, G.clamped(G.box(*(F.lit(v) for v in (-0.1, 0.2, 1.5, 0.4)))))[0][:] == (0.0, 0.2, 1.0, 0.4)
    assert one(spark, *(plumbing.safe_id(F.lit(x)) for x in ("a-1_B", "../x", "", "-a", "a" * 129)))[:] == (True, False, False, False, False)
    bad = ["", "---\nx", "%%{init", "a\nclick b", "callback", "style x", "see https://x", "[a](b)", "<img x", "graph TD\nA-->B"]
    got = spark.createDataFrame([(x,) for x in bad], "s string").select(plumbing.diagram_error(F.col("s"), 100, 10).alias("e")).collect()
    assert [r["e"] for r in got] == ["empty", "frontmatter", "directive", "interaction", "interaction", "style", "url", "embedded", "embedded", None]


def test_stop_and_budget(spark):
    calls = spark.createDataFrame([(1, i, i, o, s) for i, (o, s) in enumerate([("ok", 50.0), ("timeout", 100.0), ("ok", 40.0), ("timeout", 1.0)])], "k int, page_number int, ord int, outcome string, seconds double")
    assert [r["outcome"] for r in plumbing.stop_after_timeout(calls, "k").orderBy("page_number").collect()] == ["ok", "timeout", "skipped_after_timeout", "skipped_after_timeout"]
    assert [(r["made"], r["left"]) for r in plumbing.call_budget(calls, ["k"]).orderBy("ord").collect()] == [(True, 180.0), (True, 130.0), (True, 30.0), (False, 0.0)]


# ---- order repair, added rows, lines, bands


def brute_columns(boxes, width):
    rows = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    slim = sorted((i for i in rows if boxes[i][2] - boxes[i][0] <= 0.68 * width), key=lambda i: boxes[i][0] + boxes[i][2])
    if len(slim) < 4:
        return rows
    at = [(boxes[i][0] + boxes[i][2]) / 2 for i in slim]
    gap, cut = max((b - a, k) for k, (a, b) in enumerate(zip(at, at[1:], strict=False), 1))
    left, right = slim[:cut], slim[cut:]
    if gap < 0.18 * width or len(left) < 2 or len(right) < 2:
        return rows
    top, bottom = min(boxes[i][1] for i in slim), max(boxes[i][3] for i in slim)
    wide = [i for i in rows if i not in slim]
    above, below = [i for i in wide if boxes[i][3] <= top], [i for i in wide if boxes[i][1] >= bottom and boxes[i][3] > top]
    return rows if len(above) + len(below) < len(wide) else above + [i for i in rows if i in left] + [i for i in rows if i in right] + below


def test_columns_first():
    rng = random.Random(5)
    for _ in range(500):
        boxes = []
        for k in range(rng.randint(1, 9)):
            x, y = rng.choice((0, 10, 300, 310)), k * 20 + rng.randint(0, 5)
            boxes.append((x, y, x + rng.choice((200, 250, 550)), y + 10))
        assert order.columns_first(boxes, 600) == brute_columns(boxes, 600)


def test_native_order_repair(spark):
    said = [f"Paragraph number {w} has its own words" for w in ("one", "two", "three", "four", "five")]
    box = lambda i: (50.0, 20.0 * i, 500.0, 20.0 * i + 10)
    pages = [(1, 1, "\n\n".join([said[4], said[0], said[2], "| a |", said[1], said[3]]), "native", 600, 800), (2, 1, "\n\n".join(said), "native", 600, 800), (3, 1, "\n\n".join([*reversed(said), "and more that no block has"]), "native", 600, 800), (4, 1, "\n\n".join(reversed(said)), "scanned", 600, 800)]
    blocks = [(p, 1, i, t, *box(i)) for p in (1, 2, 3, 4) for i, t in enumerate(said)]
    parts = [(1, 1, 0, "| a |", 0.1, 0.2, 0.9, 0.22)]
    got = order.native_order_repair(
        spark.createDataFrame(pages, "content_id int, page_number int, content string, source_kind string, page_width int, page_height int"),
        spark.createDataFrame(blocks, "content_id int, page_number int, ord int, text string, left double, top double, right double, bottom double"),
        spark.createDataFrame(parts, "content_id int, page_number int, ordinal int, rendered string, left double, top double, right double, bottom double"),
    )
    rows = {r["content_id"]: r for r in got.collect()}
    assert rows[1]["content"] == "\n\n".join([*said, "| a |"]) and rows[1]["code"] == "native_reading_order_repaired"
    assert (rows[2]["content"], rows[2]["code"]) == (pages[1][2], None)
    assert rows[3]["content"] == pages[2][2] and rows[3]["code"] == "reading_order_inversion" and "character_coverage" in rows[3]["rejected"]
    assert rows[4]["code"] is None


def test_added_rows(spark):
    table = [["Cash", "1"], ["Total assets", "3"], ["Net", "9"]]
    source = [["Cash", "1"], ["Bonds", "2"], ["Total assets", "3"], ["only"], ["Loss", "5", "6"], ["Private", ""], ["Tail", "7"], ["Late", ""]]
    got = visual.supplemented(table, source, 2)
    assert got == [(["Cash", "1"], False), (["Bonds", "2"], True), (["Total assets", "3"], False), (["Net", "9"], False), (["Tail", "7"], True)]
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(table)], "t int, row_index int, cells array<string>")
    other = spark.createDataFrame([(1, i, r, True) for i, r in enumerate([["Item", "Sum"], *source])], "t int, row_index int, cells array<string>, has_header boolean")
    assert [(r["cells"], r["added"]) for r in visual.supplement_rows(rows, other, ["t"]).orderBy("row_index").collect()] == got
    cells = visual.attached(rows, other, ["t"]).collect()
    assert sorted((r["row_index"], r["col"], r["value"]) for r in cells) == [(0, 0, "Cash"), (0, 1, "1"), (1, 0, "Total assets"), (1, 1, "3")]


def test_repeated_lines(spark):
    assert visual.deduplicated(["A seal text", "x", "a  seal text", "a seal textt", "y"], ["A seal text"]) == ["A seal text", "x", "y"]
    assert visual.deduplicated(["ab", "ab"], [""]) == ["ab", "ab"]
    pages = spark.createDataFrame([("# 甲乙丙丁股份有限公司\n甲乙丙了股份有限公司\n| 甲乙丙了股份有限公司 |\n完全不同的公司\n\n\n\nx", "甲乙丙丁股份有限公司"), ("公司", None)], "content string, company string")
    assert [r["content"] for r in visual.company_variants_dropped(pages).collect()] == ["# 甲乙丙丁股份有限公司\n| 甲乙丙了股份有限公司 |\n完全不同的公司\n\nx", "公司"]


def test_bands(spark):
    rows = spark.createDataFrame([(0, 5, 2, 0), (1, 21, 8, 0), (2, 60, 8, 0), (3, 60, 8, 1), (4, 60, 3, 5)], "id int, row_lines int, column_lines int, calls int")
    assert [(r["bands"], r["parallel"]) for r in visual.band_plan(rows).orderBy("id").collect()] == [(1, False), (1, True), (2, True), (2, True), (1, False)]


def test_sinks_and_records(spark, tmp_path):
    results = spark.createDataFrame([("a", "{}", "# m", "m", ["w"]), ("b", "{}", "n", "n", [])], "content_id string, result string, markdown string, plain_text string, warnings array<string>")
    sinks.write_results(results, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/warnings")).count() == 1 and spark.read.parquet(str(tmp_path / "r/markdown")).count() == 2
    assets = spark.createDataFrame([("x", F_SHA), ("y", "0" * 64)], "name string, sha256 string")
    files = spark.createDataFrame([(bytearray(b"abc"),)], "content binary")
    assert [r["name"] for r in sinks.verified_bundle(assets, files).collect()] == ["x"]
    (tmp_path / "m.json").write_text('{"version": 2, "cases": [{"id": "one", "unit_range": "1"}, {"id": "two", "unit_range": "2"}]}')
    got = {r["id"]: r["error"] for r in readers.manifest(spark, str(tmp_path / "m.json"), ["one", "none"]).collect()}
    assert got == {"one": None, "none": "unknown_case"}
    old = spark.createDataFrame([('{"object":"content.parse.job","options":{"page_range":"1","x":"2"}}',), ('{"object":"content.parse.job","options":{"unit_range":"1"}}',)], "t string")
    options, legacy = readers.decoded_record(F.col("t"), ["unit_range"])
    assert [(r["o"], r["l"]) for r in old.select(options.alias("o"), legacy.alias("l")).collect()] == [({"unit_range": "1"}, True), ({"unit_range": "1"}, False)]


# ---- recipes


def test_prepared_pages(spark):
    said = [f"Paragraph number {w} has its own words" for w in ("one", "two", "three", "four", "five")]
    schema = "content_id int, page_number int, content string, source_kind string, page_width int, page_height int, status string, rotation int, native_chars int, fused boolean, conflicts int"
    page = lambda i, text, kind="native": (i, 1, text, kind, 600, 800, "completed", 0, 10, False, 0)
    pages = [page(1, "\n\n".join([said[3], said[0], said[2], said[1], said[4]])), page(2, "x", "mixed"), page(3, "a­ word and some more of it"), page(4, "some text that is read badly"), page(5, "", "mixed")]
    native = [(1, 1, "\n".join(said)), (4, 1, "目录\none.....1\ntwo.....2\nthree.....3")]
    blocks = [(1, 1, i, t, 50.0, 20.0 * i, 500.0, 20.0 * i + 10) for i, t in enumerate(said)]
    got = recipes.prepared_pages(
        spark.createDataFrame(pages, schema), spark.createDataFrame(native, "content_id int, page_number int, native_text string"),
        spark.createDataFrame(blocks, "content_id int, page_number int, ord int, text string, left double, top double, right double, bottom double"),
        spark.createDataFrame([], "content_id int, page_number int, ordinal int, rendered string, left double, top double, right double, bottom double"),
    )
    rows = {r["content_id"]: (r["content"], r["codes"], r["status"], r["verdict"], r["strategy"]) for r in got.collect()}
    assert rows[1] == ("\n\n".join(said), [], "completed", "trusted", "native_repair")
    assert rows[2][1:4] == (["low_text_content"], "warning", "untrusted")
    assert rows[3][1] == ["suspicious_unicode_glyphs"]
    assert rows[4][0] == "# 目录\n\n- one …… 1\n- two …… 2\n- three …… 3" and rows[4][4] == "native_repair"
    assert rows[5][1:4] == (["no_usable_content"], "failed", "untrusted")


def test_signature_pages(spark):
    pages = spark.createDataFrame([(1, 1, "合同双方签字盖章\n合同双方签字盖章\n公司章\n张三\n李\nend"), (2, 1, "x\n张三")], "content_id int, page_number int, content string")
    seen = spark.createDataFrame([(1, 1, ["合同双方签字盖章", "李"], ["合同双方签字盖章"], ["公司章", "合同双方签字盖章"], True), (2, 1, None, None, None, False)], "content_id int, page_number int, printed array<string>, repeated array<string>, sealed array<string>, marked boolean")
    got = {r["content_id"]: r["content"] for r in recipes.signature_pages(pages, seen).collect()}
    assert got == {1: "合同双方签字盖章\n李\nend\n\n<!-- image -->", 2: "x\n张三"}


def test_fold_agrees_with_its_steps(spark):
    """Bands, votes and Markdown of the fold are those of the operators over tables, on odd cells too."""
    dice = random.Random(5)
    cells = ["", None, " ", "a", "A ", "ß", "SS", "−1", "-1", "<b>|", "x\ny", "\u3000a", "Item", "İ"]
    rows = [(p, dice.randrange(3), "single", dice.choice([[], ["Item", "Sum"]]), i, dice.choice(["header", "data", None]), dice.choices(cells, k=dice.randrange(1, 4))) for p in range(60) for i in range(dice.randrange(1, 9))]
    schema = "page int, band int, table_id string, columns array<string>, row_index int, kind string, cells array<string>"
    want: dict[int, list] = {}
    for r in visual.band_combine(spark.createDataFrame(rows, schema), "page").orderBy("page", "out_index").collect():
        want.setdefault(r["page"], []).append(r["cells"])
    got = {p: fused.combined([(0, b, i, c, k, None, x) for q, b, _, c, i, k, x in rows if q == p])[1] for p in range(60)}
    assert want and {p: x for p, x in got.items() if x} == want
    heard = [(k, s, dice.choice(cells)) for k in range(200) for s in ("glm", "qwen", "docling", "other") if dice.random() < 0.8]
    votes = {k: fused.vote([(s, v) for j, s, v in heard if j == k and s != "other"]) for k in {j for j, s, _ in heard if s != "other"}}
    one = spark.createDataFrame(heard, "k int, source string, value string")
    assert {r["k"]: tuple(r)[1:] for r in fusion.field_consensus(one, ["k"]).collect()} == {k: v[2:] for k, v in votes.items()}
    strength = fusion.evidence_strength(one.withColumn("col", F.lit(0)), ["k"]).collect()
    assert {r["k"]: (r["agreements"], r["coverage"]) for r in strength} == {k: v[:2] for k, v in votes.items() if v[1]}
    shown = tables.gfm_render(spark.createDataFrame([(1, 0, cells[:7]), (1, 1, cells[7:])], "page int, row_index long, cells array<string>"), ["page"])
    assert shown.first()["markdown"] == fused.markdown([cells[:7], cells[7:]])


def test_fused_tables(spark):
    rows = [(1, 0, "single", ["Item", "Sum"], 0, "header", ["Item", "Sum"]), (1, 0, "single", ["Item", "Sum"], 1, "data", ["Cash", "1"]), (1, 0, "single", ["Item", "Sum"], 2, "data", ["Bonds", "2"]), (1, 1, "single", [], 0, "data", ["Bonds", "2"]), (1, 1, "single", [], 1, "data", ["Total", "8"])]
    bands = spark.createDataFrame(rows, "page int, band int, table_id string, columns array<string>, row_index int, kind string, cells array<string>")
    schema = "page int, table_id string, row_index int, cells array<string>, has_header boolean"
    glm = spark.createDataFrame([(1, "single", i, c, True) for i, c in enumerate([["Item", "Sum"], ["Cash", "1"], ["Bonds", "2"], ["Loans", "3"], ["Total", "9"]])], schema)
    docling = spark.createDataFrame([(1, "single", i, c, True) for i, c in enumerate([["Item", "Sum"], ["Cash", "7"], ["Total", "9"]])], schema)
    tables, cells = recipes.fused_tables(bands, {"glm": glm, "docling": docling}, "page")
    got = tables.first()
    assert got["markdown"].split("\n") == ["| Item | Sum |", "| --- | --- |", "| Cash | 1 |", "| Bonds | 2 |", "| Loans | 3 |", "| Total | 9 |"]
    assert (got["parsed"], got["conflicts"], got["qwen_only"]) == (8, 0, 0) and got["agreed"] == 6
    assert cells.count() == 8
