"""Literal cases of single operators."""

from __future__ import annotations

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import pyfuncs
from quirelake.functions import text as T
from quirelake.operators import fuzzy, jobs, layout, media, quality, tables, units
from quirelake.sources import readers, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "total", "want"),
    [
        ("8, 1-3, 2, 10-11", 12, [1, 2, 3, 8, 10, 11]), (None, 3, [1, 2, 3]), (" ", 2, [1, 2]), ("0", 9, "invalid_item"), ("3-1", 9, "reversed"),
        ("1,,2", 9, "empty_item"), ("-2", 9, "invalid_item"), ("1-", 9, "invalid_item"), ("one", 9, "invalid_item"), ("4-12", 9, "beyond_total"), ("1-200000", 300000, "too_many"),
    ],
)
def test_unit_range(spark, value, total, want):
    got = units.unit_range_expand(spark.createDataFrame([(1, value, total)], "id int, value string, total long")).collect()
    assert [r["error"] for r in got] == [want] if isinstance(want, str) else sorted(r["unit"] for r in got) == want


def test_runs(spark):
    rows = spark.createDataFrame([(1, u) for u in (5, 1, 2, 3, 8, 8)] + [(2, u) for u in (1, 2, 1000, 1002, 1003)], "k int, u long")
    assert {r["k"]: r["units"] for r in units.unit_range_format(rows, "k", "u").collect()} == {1: "1-3,5,8", 2: "1-2,1000,1002-1003"}
    assert sorted(map(tuple, units.consecutive_groups(rows, "k", "u").where("k = 2").collect())) == [(2, 1, 2), (2, 1000, 1000), (2, 1002, 1003)]


def test_text_functions(spark):
    assert one(spark, "A　b\u001c<!-- x\ny -->*c*ß", T.compact_text) == "abcss"
    assert one(spark, None, T.normalized) == ""
    assert one(spark, "−1 234", T.normalized) == "-1234"
    assert one(spark, "x1 −(1,234.50%) 7 a9 12,000", T.number_tokens) == ["-(1234.50%)", "7", "12000"]
    assert one(spark, "2024 年 1月2日 2024年1月2日", T.date_tokens) == ["2024年1月2日"]
    assert one(spark, " ".join(chr(c) for c in range(0x72B2, 0x72C0)), T.mojibake) is True
    assert one(spark, "一只犃", T.mojibake) is False
    assert one(spark, "a\r\nb\n", T.lines) == ["a", "b"]
    assert one(spark, "a | b\n<c> & ", T.gfm_cell) == "a &#124; b &lt;c&gt; &amp;"
    assert one(spark, "a  \r\n\n\n\n\nb\0 ", T.markdown_normalized) == "a\n\n\nb"


def test_repeats_and_exemptions(spark):
    pages = spark.createDataFrame([(1, "\n".join(["来源链接："] * 6)), (2, "A real sentence. " * 5), (3, "| A real cell |\n" * 6)], "k int, content string")
    assert [(r["k"], r["repeat_count"]) for r in quality.repeat_fragments(pages, ["k"]).collect()] == [(2, 5)]


def test_verdicts(spark):
    schema = "content_id int, page_number int, status string, content string, source_kind string, rotation int, native_chars long, fused boolean, conflicts int"
    long = "A sentence that is long enough to be fine."
    rows = [
        (1, 1, "completed", long, "mixed", 0, 10, False, None), (1, 2, "completed", "", "mixed", 0, 10, False, None), (1, 3, "completed", "tiny", "sparse", 0, 10, False, None),
        (1, 4, "completed", "tiny", "mixed", 0, 10, True, 0), (1, 5, "completed", long, "mixed", 90, 10, True, 2), (1, 6, "failed", long, "mixed", 0, 10, True, 0), (1, 7, "completed", long, "native", 0, 900, False, None),
    ]
    got = quality.assess(quality.page_codes(spark.createDataFrame(rows, schema), ["content_id", "page_number"]))
    found = {r["page_number"]: (r["status"], r["verdict"], r["codes"]) for r in got.collect()}
    assert found == {
        1: ("completed", "trusted", []), 2: ("failed", "untrusted", ["no_usable_content"]), 3: ("completed", "trusted", ["intentional_sparse_page"]),
        4: ("warning", "degraded", ["low_text_content"]), 5: ("completed", "degraded", ["rotated_scan"]), 6: ("failed", "untrusted", []), 7: ("warning", "untrusted", ["visual_text_mismatch"]),
    }
    s = quality.quality_summary(got, "content_id").first()
    assert (s["trusted_pages"], s["degraded_pages"], s["untrusted_pages"], s["failed_pages"], s["acceptable"]) == (2, 2, 3, 2, False)


@pytest.mark.parametrize(("chars", "cover", "ink", "want"), [(100, 0.9, 0.1, "document"), (20, 0.9, 0.1, "mixed"), (0, 0.9, 0.1, "visual"), (0, 0.1, 0.2, "unknown")])
def test_image_class(spark, chars, cover, ink, want):
    assert spark.range(1).select(units.image_class(F.lit(chars), F.lit(cover), F.lit(ink), F.lit(True))).first()[0] == want


def test_geometry(spark):
    b = lambda *x: G.box(*(F.lit(float(v)) for v in x))
    got = spark.range(1).select(G.iou(b(0, 0, 1, 1), b(0, 0, 1, 0.5)), G.coverage(b(0, 0, 1, 1), b(0.5, 0, 2, 1)), G.coverage(b(0, 0, 0, 1), b(0, 0, 1, 1)), G.rotated(b(0.1, 0.2, 0.3, 0.4), F.lit(90)), G.valid(b(0.5, 0, 0.2, 1))).first()
    assert got[:3] == (0.5, 0.5, 0.0)
    assert [round(v, 9) for v in got[3]] == [0.6, 0.1, 0.8, 0.3]
    assert got[4] is None


def brute_order(blocks, width):
    by_y = sorted(blocks, key=lambda b: (b[1], b[0], b[4]))
    narrow = sorted((b for b in by_y if b[2] - b[0] <= 0.68 * width), key=lambda b: ((b[0] + b[2]) / 2, b[1], b[0], b[4]))
    if len(narrow) < 4:
        return by_y
    gap, i = max(((r[0] + r[2]) / 2 - (x[0] + x[2]) / 2, k) for k, (x, r) in enumerate(zip(narrow, narrow[1:], strict=False)))
    left, right = narrow[: i + 1], narrow[i + 1 :]
    if gap < 0.18 * width or min(len(left), len(right)) < 2:
        return by_y
    rest = [b for b in by_y if b not in narrow]
    top, bottom = min(b[1] for b in narrow), max(b[3] for b in narrow)
    before, after = [b for b in rest if b[3] <= top], [b for b in rest if b[3] > top and b[1] >= bottom]
    if len(before) + len(after) < len(rest):
        return by_y
    y = lambda b: (b[1], b[0], b[4])
    return sorted(before, key=y) + sorted(left, key=y) + sorted(right, key=y) + sorted(after, key=y)


def test_reading_order(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for page in range(200):
        blocks = []
        for k in range(rng.randint(1, 9)):
            left = rng.choice((0.05, 0.1, 0.55, 0.6))
            wide = rng.choice((0.3, 0.35, 0.8)) if left < 0.5 else 0.3
            top = rng.randint(0, 18) / 20
            blocks.append((left, top, left + wide, top + 0.04, k))
        rows += [(1, page, b[4], b[0], b[1], b[2], b[3]) for b in blocks]
        want[page] = [b[4] for b in brute_order(blocks, 1.0)]
    df = spark.createDataFrame(rows, "content_id int, page_number int, ord int, a double, b double, c double, d double")
    df = df.select("content_id", "page_number", "ord", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("bbox"), F.lit(1.0).alias("page_width"))
    got = {}
    for r in layout.reading_order(df).orderBy("page_number", "reading_order").collect():
        got.setdefault(r["page_number"], []).append(r["ord"])
    assert got == want


def test_headings_use_the_median(spark):
    sizes = [10.0, 12.0, 9.0, 0.0, 15.0]
    df = spark.createDataFrame([(1, 1, i, s, False) for i, s in enumerate(sizes)], "content_id int, page_number int, ord int, size double, bold boolean")
    got = layout.heading_flag(df).orderBy("ord").collect()
    assert {r["median_size"] for r in got} == {statistics.median(s for s in sizes if s)}
    assert [r["heading"] for r in got] == [False, False, False, False, True]


def greedy_links(layouts):
    """(page, number of tables): all neighbours fit."""
    used, out = set(), []
    for page in sorted(layouts):
        a, b = (page, layouts[page] - 1), (page + 1, 0)
        if page + 1 in layouts and a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def test_links_consume_their_fragments(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for doc in range(150):
        layouts = {p: rng.choice((1, 1, 1, 2)) for p in range(rng.randint(1, 9)) if rng.random() < 0.85}
        rows += [(doc, p, p * 10 + k, k, True, 0.1, 0.9, [0.0, 0.5], "h", True, 2) for p, n in layouts.items() for k in range(n)]
        want |= {(doc, a[0] * 10 + a[1], b[0] * 10 + b[1]) for a, b in greedy_links(layouts)}
    df = spark.createDataFrame(rows, "content_id int, page_number int, fragment_id int, ordinal int, valid boolean, top double, bottom double, boundaries array<double>, header string, has_header boolean, n_rows int")
    assert {tuple(r) for r in tables.cross_page_link(df).collect()} == want


def brute_frames(duration, candidates, rate, most=24, spacing=2.0):
    import math

    tail = min(max(0.05, 1.25 / rate), duration / 2) if rate else min(0.05, duration / 100)
    end = max(0.0, duration - tail)
    room = max(0, most - (2 if end > 0 else 1))
    if len(candidates) > room:
        best = {}
        for t, s in candidates:
            k = min(most - 1, int(t / max(duration / most, 0.001)))
            if k not in best or (-s, t) < best[k]:
                best[k] = (-s, t)
        candidates = [(t, -s) for s, t in best.values()]
    target = min(most, max(3, math.ceil(duration / 10) + 2))
    every = sorted([(-s, t) for t, s in candidates] + [(0.0, duration * i / (target - 1)) for i in range(1, target - 1)])
    taken = [0.0] + ([end] if end > 0 else [])
    for _, t in every:
        t = min(end, max(0.0, t))
        if len(taken) < min(most, room + 2) and all(abs(t - k) >= spacing for k in taken):
            taken.append(t)
    return sorted(taken)


def test_keyframes(spark):
    rng = random.Random(3)
    videos = [(0, 1.0, None, [(0.4, 0.9)]), (1, 6.0, 12.0, [])]
    for i in range(2, 60):
        d = rng.choice((0.5, 6.0, 30.0, 240.0, 700.0))
        videos.append((i, d, rng.choice((None, 1.0, 25.0)), [(round(rng.uniform(0, d), 2), round(rng.random(), 1)) for _ in range(rng.choice((0, 3, 22, 60)))]))
    df = spark.createDataFrame([(i, d, r, [{"t": t, "score": s} for t, s in c]) for i, d, r, c in videos], "v int, duration double, frame_rate double, candidates array<struct<t:double,score:double>>")
    got = {}
    for r in media.keyframe_select(df, "v").collect():
        got.setdefault(r["v"], []).append(r["t"])
    for i, d, r, c in videos:
        assert [round(t, 9) for t in sorted(got[i])] == [round(t, 9) for t in brute_frames(d, c, r)]
    assert got[0] == [0.0, 0.99]


def test_states(spark):
    steps = ["queued", "running", "running", "completed", "running"]
    df = spark.createDataFrame([(1, i, s, i) for i, s in enumerate(steps)], "job_id int, id int, status string, at int")
    assert [r["verdict"] for r in jobs.job_state_machine(df).orderBy("id").collect()] == ["start", "allowed", "same", "allowed", "error"]


def test_ratio_is_that_of_the_library(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", None), ("ab" * 50, "ba" * 50)]
    got = spark.createDataFrame(pairs, "a string, b string").select(pyfuncs.seq_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [None if b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert pyfuncs.bounded_ratio(a, b, 0.8) == r or r < 0.8


def test_bounds_of_a_ratio_hold():
    """Characters that share a place, and more of one than have room."""
    rng = random.Random(6)
    for _ in range(500):
        a = "".join(rng.choice("a!\u00e1bé漢") for _ in range(rng.randint(0, 120)))
        b = "".join(c for c in a if rng.random() > 0.15) + rng.choice(["", "!" * 40, "a"])
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert pyfuncs.bounded_ratio(a, b, 0.86) == r or r < 0.86


def test_labels(spark):
    rows = [{"label": x, "row_index": i} for i, x in enumerate(["Total assets", "Total  ASSETS", "Net profit", "Net profits", "Cash"])]
    assert fuzzy.best_labels(["cash", "total assets", "net profitz", "", "zzz"], rows, 0.86) == [4, None, 2, None, None]
    assert fuzzy.best_labels(["cashh"], rows, 0.86) == [4]


def test_replay_and_overlap():
    row = lambda band, i, *cells: {"band": band, "row_index": i, "cells": list(cells), "strength": 0}
    first = [row(0, i, f"r{i}", "1", "2") for i in range(5)]
    assert fuzzy.kept_after_replay([*first, *(row(1, i, f"r{i}", "1", "") for i in range(3)), row(1, 9, "new", "5", "6")]) == [0, 1, 2, 3, 4, 8]
    assert len(fuzzy.kept_after_replay([*first, *(row(1, i, f"r{i}", "1", "2") for i in range(3))])) == 8
    assert len(fuzzy.kept_after_replay([*first, row(1, 0, "r0", "1", ""), row(1, 1, "r1", "", "")])) == 7
    a, b, c = row(0, 0, "x", "1", "2"), row(0, 1, "x", "1", "3") | {"strength": 5}, row(0, 2, "y", "1", "2")
    assert fuzzy.kept_of_overlap([a, b, c]) == [1, 2]
    assert fuzzy.kept_of_overlap([a, row(0, 1, "x", "8", "9"), a]) == [0, 1]


def greedy_repair(parts, least=0.8):
    """Fragments by page, repaired one after the other."""
    parts = [dict(p) for p in parts]
    for page in sorted({p["page_number"] for p in parts}):
        here, after = ([p for p in parts if p["page_number"] == n] for n in (page, page + 1))
        if not after:
            continue
        a, b = max(here, key=lambda p: p["ordinal"]), min(after, key=lambda p: p["ordinal"])
        if not (a["valid"] and b["valid"] and a["bottom"] >= 0.85 and b["top"] <= 0.15 and a["rows"] and b["rows"]):
            continue
        blank = [i for i, c in enumerate(a["rows"][0]) if not c.strip()]
        names = ["|".join("".join(c.split()).casefold() for c in x["rows"][0] if c.strip()) for x in (a, b)]
        edges = (abs(a["boundaries"][0] - b["boundaries"][0]) + abs(a["boundaries"][-1] - b["boundaries"][-1])) / 2
        if not blank or len(a["rows"][0]) - len(b["rows"][0]) != len(blank) or not all(names) or difflib.SequenceMatcher(None, *names).ratio() < least or edges > 0.02:
            continue
        wide = []
        for r in b["rows"]:
            own = iter(r)
            wide.append(["" if i in blank else next(own) for i in range(len(a["rows"][0]))] if len(r) == len(b["rows"][0]) else None)
        if None not in wide:
            b["rows"], b["boundaries"] = wide, a["boundaries"]
    return parts


def test_continuation(spark):
    rng = random.Random(8)
    heads = [["Name", "", "Sum"], ["Name", "Sum"], ["Names", "Sum"], ["Name", "", "Sum", ""], ["", ""], ["Other", "x"]]
    parts = []
    for doc in range(120):
        for page in range(rng.randint(1, 6)):
            for k in range(rng.choice((1, 1, 1, 2))):
                head = rng.choice(heads)
                rows = [head] + [[f"{page}{i}" for i in range(len(head) + (rng.random() < 0.05))]]
                parts.append((doc, page, k, rng.random() < 0.95, rng.choice((0.1, 0.1, 0.1, 0.3)), 0.9, [0.0, rng.choice((0.5, 0.5, 0.6))], rows if rng.random() < 0.95 else []))
    schema = "content_id int, page_number int, ordinal int, valid boolean, top double, bottom double, boundaries array<double>, rows array<array<string>>"
    df = spark.createDataFrame(parts, schema)
    names = [f.name for f in df.schema]
    want = {}
    for doc in range(120):
        for p in greedy_repair([dict(zip(names, x, strict=True)) for x in parts if x[0] == doc]):
            want[doc, p["page_number"], p["ordinal"]] = (p["rows"], p["boundaries"])
    got = {(r["content_id"], r["page_number"], r["ordinal"]): (r["rows"], r["boundaries"]) for r in fuzzy.continuation_repair(df).collect()}
    assert got == want
    assert sum(g[0] != list(p[7]) for g, p in zip((got[x[:3]] for x in parts), parts, strict=True)) > 5


def test_replay_of_random_bands():
    """Against a statement of the rule by brute force: no run is missed, none is cut."""
    rng = random.Random(9)
    for _ in range(400):
        rows = [{"band": band, "row_index": i, "cells": [rng.choice(("", "a", "b", "c", "d")), rng.choice(("", "1")), rng.choice(("", "2"))]} for band in range(rng.randint(1, 3)) for i in range(rng.randint(1, 7))]
        kept = []
        for band in sorted({r["band"] for r in rows}):
            own, runs, run, last = [r for r in rows if r["band"] == band], [], [], -1
            if kept and len(own) >= 3:
                full = lambda r: sum(bool(c) for c in r["cells"][1:])
                for r in own:
                    at = [k for k in range(last + 1, len(kept)) if r["cells"][0] and kept[k]["cells"][0] == r["cells"][0]]
                    if at and full(r) <= full(kept[at[0]]):
                        run.append((r, full(r) < full(kept[at[0]])))
                        last = at[0]
                    else:
                        runs, run, last = [*runs, run], [], -1
                gone = [id(r) for x in [*runs, run] if sum(less for _, less in x) >= 3 for r, less in x if less]
                own = [r for r in own if id(r) not in gone]
            kept += own
        assert [rows[i] for i in fuzzy.kept_after_replay(rows)] == kept


def test_html_grid():
    html = "<table><tr><th rowspan='2'>H</th><th colspan=2>a &amp; b<br>c</th></tr><tr><td> x  y </td></tr></table>"
    grid = readers.html_grid(html + "<p><TABLE><tr><td title='a>b'>second<!-- no --></TD></tr></table>")
    assert [t for n, r, _, t, _ in grid if (n, r) == (0, 0)] == ["H", "a & b c", ""]
    assert [t for n, r, _, t, _ in grid if (n, r) == (0, 1)] == ["", "x y", ""]
    assert [x for x in grid if x[0] == 1] == [(1, 0, 0, "second", False)]
    nested = readers.html_grid("<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table>")
    assert [(n, t) for n, _, _, t, _ in nested] == [(0, "ac"), (0, "d"), (1, "b")]
    assert readers.html_grid("<tr><td colspan=101>x</td></tr>") == [] == readers.html_grid(None)
    assert readers.html_grid("<tr><td rowspan=2001>x</td></tr>" + "<tr><td>y</td></tr>" * 2000) == []


def test_folding_is_that_of_unicode(spark):
    texts = ["Straße ẞ", "ΣΊΣΥΦΟΣ ς", "ﬁnal ﬀ", "İstanbul", "ŉ ǰ ΐ", "Ꭰ ꭰ", "plain", "", None, "".join(T._folded())]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [None if t is None else t.casefold() for t in texts]


def test_sizes_and_texts(spark):
    sizes = [None, 0, 1023, 1024, 1536, 10 * 1024, 10239, 1048575, 1048576, 12 * 1048576 + 600000, 5 * 2**30, 3000 * 2**30]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(T.bytes_format(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == ["—", "0 B", "1023 B", "1.00 KB", "1.50 KB", "10.0 KB", "10.00 KB", "1024.0 KB", "1.00 MB", "12.6 MB", "5.00 GB", "3000.0 GB"]
    # any mark may close a pair that another one opens
    marked = ["**a** \\**b** `c`", "&copy;&#233;&amp;lt;", "> - 1. x\n```py\ncode\n```\n\n\n\n[l](u) ![i](v) <b>t</b>", "## H\ntext\t\n"]
    got = spark.createDataFrame([(t,) for t in marked], "t string").select(T.markdown_to_text(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == ["a \\**b c`", "©é&lt;", "x\ncode\n\nl i t", "H\ntext"]


def test_headers_alike_link_and_merge(spark):
    rows = [(1, 1, 10, 0, True, 0.1, 0.9, [0.0, 0.5], "total|amount", True, 3), (1, 2, 20, 0, True, 0.1, 0.9, [0.0, 0.5], "total|amounts", True, 3), (2, 1, 30, 0, True, 0.1, 0.9, [0.0, 0.5], "total|amount", True, 3),
            (2, 2, 40, 0, True, 0.1, 0.9, [0.0, 0.5], "x", False, 3), (3, 1, 50, 0, True, 0.1, 0.9, [0.0, 0.5], "abc", True, 3), (3, 2, 60, 0, True, 0.1, 0.9, [0.0, 0.5], "xyz", True, 3)]
    df = spark.createDataFrame(rows, "content_id int, page_number int, fragment_id int, ordinal int, valid boolean, top double, bottom double, boundaries array<double>, header string, has_header boolean, n_rows int")
    assert sorted(map(tuple, tables.cross_page_link(df).collect())) == [(1, 10, 20), (2, 30, 40)]
    cells = [(10, 0, ["Total", "Amount"], True), (10, 1, ["a", "1"], True), (20, 0, ["total", "amounts"], True), (20, 1, ["b", "2"], True), (30, 0, ["Total", "Amount"], True), (40, 0, ["c", "3"], False)]
    got = tables.merged_rows(spark.createDataFrame([(10, 20), (30, 40)], "left_id int, right_id int"), spark.createDataFrame(cells, "fragment_id int, row_index int, cells array<string>, has_header boolean"))
    assert sorted((r["left_id"], r["row_index"], r["cells"]) for r in got.collect()) == [(10, 0, ["Total", "Amount"]), (10, 1, ["a", "1"]), (10, 2, ["b", "2"]), (30, 0, ["Total", "Amount"]), (30, 1, ["c", "3"])]


def test_grid_anchor(spark):
    assert tables.anchored([(0, 1, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1), (1, 3, 0, 1), (0, 0, 0, 1)], 2, 2) == ([True, False, True, False, False], ["overlapping_cells", "cell_out_of_bounds"])
    assert tables.anchored([(0, 1, 0, 1)], 0, 1) == ([False], ["invalid_dimensions"])
    df = spark.createDataFrame([(1, 2, 2, 5, 0, 1, 0, 2), (1, 2, 2, 3, 0, 1, 0, 1)], "t int, num_rows int, num_cols int, arrival int, top int, bottom int, left int, right int")
    assert tables.grid_anchor(df, ["t"]).first().asDict() == {"t": 1, "arrivals": [3], "reasons": ["overlapping_cells"]}


def walk(statuses):
    """A job's verdicts, one after the other."""
    state, out = None, []
    for s in statuses:
        verdict = "start" if state is None else "same" if s == state else "allowed" if s in jobs.ALLOWED.get(state, []) else "error"
        state = s if verdict in ("start", "allowed") else state
        out.append((verdict, state))
    return out


def test_illegal_moves_leave_the_state(spark):
    rng = random.Random(12)
    logs = {j: [rng.choice(("queued", "running", "completed", "partial", "failed", "cancelled")) for _ in range(rng.randint(1, 9))] for j in range(400)}
    df = spark.createDataFrame([(j, i, s, 100 + i) for j, log in logs.items() for i, s in enumerate(log)], "job_id int, id int, status string, at int")
    got = {(r["job_id"], r["id"]): r["verdict"] for r in jobs.job_state_machine(df).collect()}
    assert got == {(j, i): v for j, log in logs.items() for i, (v, _) in enumerate(walk(log))}
    for r in jobs.transition_side_effects(df).collect():
        log = logs[r["job_id"]]
        moves = [(i, s) for i, (s, (v, _)) in enumerate(zip(log, walk(log), strict=True)) if v != "error"]
        ran, ended = [i for i, s in moves if s == "running"], [i for i, s in moves if s in jobs.TERMINAL]
        assert (r["status"], r["started_at"], r["completed_at"]) == (walk(log)[-1][1], 100 + ran[0] if ran else None, 100 + ended[-1] if ended else None)


def test_quality_rules_of_tables_and_glyphs(spark):
    pages = spark.createDataFrame([(1, "| a | 12.5% |\n12.5%"), (2, "| a | 12.5% |\n12.5% of it"), (3, "| a | 12 |\n12"), (4, "x\u00ad"), (5, "a\tb\n"), (6, "12.5%"), (7, "\U000F0000\u200b\u200b")], "p int, content string")
    got = {r["p"]: (r["a"], r["b"]) for r in pages.select("p", quality.unanchored_numbers(T.lines(F.col("content")), quality.table_rows(F.col("content"))).alias("a"), quality.suspicious_glyphs(F.col("content")).alias("b")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True), 5: (False, False), 6: (False, False), 7: (False, True)}
    assert sorted(map(tuple, quality.glyph_counts(pages, ["p"]).collect())) == [(4, "U+00AD", 1), (7, "U+200B", 2), (7, "U+F0000", 1)]


def test_names():
    assert pyfuncs.safe_name("..\\a/b?.PDF") == "b_.pdf"
    assert pyfuncs.safe_name("con.txt") == "_con.txt"
    assert pyfuncs.safe_name(None) == "content"
    assert len(pyfuncs.safe_name("x" * 500 + ".md")) == 180


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, " b "), (1, 1, "a")], "k int, page_number int, content string")
    r = sinks.document_rendering(pages, "k").first()
    assert r["plain_text"] == "--- Page 1 ---\n\na\n\n\f\n\n--- Page 2 ---\n\nb" and r["markdown"].startswith("<!-- page: 1 -->\n\na")
    assert sinks.document_rendering(pages, "k", breaks=False).first()["plain_text"] == "a\n\nb"
    assets = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, content string")
    stored = assets.where("i = 3").select(F.sha2("content", 256).alias("sha256"))
    assert [r["content"] for r in sinks.new_assets(assets, stored).collect()] == ["x"]
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7 x")
    got = readers.binary_sources(spark, str(tmp_path)).first()
    assert (got["mime"], got["length"], got["error"]) == ("application/pdf", 10, None)
    assert readers.binary_sources(spark, str(tmp_path), cap=5).first()["error"] == "too_large"
