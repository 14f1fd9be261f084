"""Operators whose parts, windows or statistics once left something out."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quirelake.llm import license_scan, pii, queries, url_filter


def test_rare_suffixes_keep_their_statistic(spark):
    rules = [("block", "org/baad/"), ("allow", "org/daab/")]
    urls = [f"http://d{i}.org/{'baad' if (i % 2 == 0) == (k > 0) else 'daab'}/{k}" for i in range(8) for k in range(36)]  # shares come from other folds, so each suffix has some rows in all
    urls += [f"http://d{i}.org/adab/{k}" for i in range(8) for k in range(2)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    few, all_ = (sorted(map(tuple, url_filter.judge_urls(pages, rules=rules, trees=3, suffixes=n).collect())) for n in (2, 1000))
    assert [r[:5] for r in few] == [r[:5] for r in all_]
    assert [r[5] for r in few] == pytest.approx([r[5] for r in all_])
    assert all(r[4] == ("allow" if int(r[1][1]) % 2 else "block") for r in few if r[3] is None)


def test_wrapped_notices_are_found(spark, tmp_path):
    cases = []
    for label, text in license_scan.TEMPLATES:
        w = text.split()
        if label in ("bsd", "mit", "isc", "mpl") and len(w) > 10:
            cases += [(label, gap.join((" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])))) for gap in (" ", "\n", "\n * ")]
            cases.append((label, "pad " * 45 + "\n" + "\n".join(w) + "\nend"))
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"].split(",") for r in queries.op1_license_scan(spark, str(tmp_path)).collect()}
    assert len(cases) == 24
    assert [i for i, (label, _) in enumerate(cases) if label not in got[i]] == []


def test_long_runs_are_decoded_whole():
    model = pii.SemiMarkov()
    model.span[pii.TYPES.index("secret") - 1, [14, 23]] = 2.0  # a long token with letters, after a named assignment
    for n in (0, 100, 180, 190, 195, 199, 390, 5000):
        text = "1" * n + ";token=ABCDEF0123456789ABCDEF;x=1"
        at = text.index("ABC")
        assert ("secret", at, at + 22) in pii.find(text, model, {})[1]
    long = "token=" + "A1b2" * 80
    assert ("secret", 6, len(long)) in pii.find(long, model, {})[1]


def test_decoding_in_steps_is_decoding_at_once(monkeypatch):
    rng, own = random.Random(3), np.random.Generator(np.random.PCG64(3))
    model = pii.SemiMarkov()
    for w in (model.span, model.single, model.move):
        w += own.normal(size=w.shape)
    text = "".join(rng.choice(("a1", "7", "@", "-", ".", "=", "key")) for _ in range(150))
    once = model.decode(pii.Region(text, 0, len(text)))
    for step in (1, 7, 64):
        monkeypatch.setattr(pii, "STEP", step)
        assert model.decode(pii.Region(text, 0, len(text))) == once
