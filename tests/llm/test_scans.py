"""Licence scans, decontamination, packing and the pipeline against brute force."""

from __future__ import annotations

import json
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quirelake.llm import decontaminate, license_scan, packing, queries
from quirelake.llm.words import ALNUM, slices
from test_dedup import classes
from test_models import BruteLanguage

SF = "/root/testdata/sf0.001"


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


# ---- licences


def brute_blocks(text: str, percent: int = 80, wrapped: bool = False) -> set[str]:
    labels = set()
    for label, template in license_scan.TEMPLATES:
        t, block = set(template.split()), 64
        while block < 2 * len(template.split()):
            block *= 2
        for line in [*(text or "").split("\n"), *([text or ""] if wrapped else [])]:
            w = words(line)
            for a in range(0, max(len(w) - block // 2, 1), block // 2):
                if 100 * len(t & set(w[a : a + block])) >= percent * len(t):
                    labels.add(label)
    return labels


def test_license_scan(docs, rows, nothing, spark):
    rng = random.Random(2)
    more = []
    for i in range(300):
        w = [x for _, t in rng.sample(license_scan.TEMPLATES, 2) for x in t.split()]
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = "other"
        w = ["pad"] * rng.randint(0, 90) + w[: rng.randint(3, len(w))] + ["end"] * rng.randint(0, 40)
        more.append((1000 + i, rng.choice((" ", "\n", " - ")).join(w) if rng.random() < 0.3 else " ".join(w)))
    every = [(r[0], r[1]) for r in rows] + more
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for wrapped in (False, True):
        check_scan(every, table, wrapped)
    assert license_scan.scan(nothing).collect() == []


def check_scan(every, table, wrapped):
    want = Counter()
    for i, t in every:
        w, base = words(t), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            base += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        at, own = sorted(x[0] for x in base), {x[1] for x in base}
        want[i, len(w), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted(own)), ",".join(sorted(own | brute_blocks(t, wrapped=wrapped)))] += 1
    got = license_scan.scan(table, wrapped=wrapped).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(0 <= r["score"] <= 1 for r in got)


def test_whole_licence_texts_are_found(spark):
    """Long paragraphs, wrapped at 70 columns, with some words changed."""
    long = [(k, label, t.split()) for k, (label, t) in enumerate(license_scan.TEMPLATES) if len(t.split()) > 32]
    assert len(long) >= 3
    docs = []
    for k, _, w in long:
        w = ["changed" if i % 17 == 5 else x for i, x in enumerate(w)]
        docs.append((k, "/*\n * " + textwrap.fill(" ".join(["Copyright", "2020", *w]), 70).replace("\n", "\n * ") + "\n */\nint x;"))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), wrapped=True).collect()}
    assert all(label in got[k]["labels"].split(",") for k, label, _ in long)


# ---- decontamination


def distance(item: list, text: list) -> int:
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, w: list, k: int) -> list:
    w = list(w)
    for _ in range(k):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"z{rng.randrange(99)}"
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, f"z{rng.randrange(99)}")
    return w


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    sizes = [5, 6, 7, 8, 10, 11, 15] * 2 + [rng.randint(8, 50) for _ in range(25)] + [70, 150]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(sizes)] + [(90, "two words"), (91, None), (92, ""), (93, "w1 w2 w3 w4")]
    docs = []
    for i in range(600):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            item = items[rng.randrange(len(sizes))][1].split()
            w += edited(rng, item, rng.randint(0, int(0.25 * len(item)))) + rng.choices(vocabulary, k=rng.randint(0, 30))
        docs.append((i, ", ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    return [*docs, (None, items[0][1]), (1000, None), (1001, ""), (1, docs[1][1])], items


def test_contamination_recall(spark, planted, nothing):
    docs, items = planted
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in docs:
        for k, item in items:
            w = words(item)
            if w and (n := distance(w, words(t))) <= len(w) // 5:
                want[i, k, n] += 1
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contamination(d, b, chunk_words=300).collect())
    pairs = lambda c: Counter({k[:2]: n for k, n in c.items()})
    assert not pairs(got) - pairs(want)  # nothing false
    assert sum((pairs(got) & pairs(want)).values()) >= 0.98 * sum(want.values())
    assert sum((got & want).values()) >= 0.98 * sum(want.values())
    size = {k: len(words(item)) for k, item in items}
    most = Counter({k: n for k, n in want.items() if k[2] == size[k[1]] // 5 > 0})  # at the largest distance allowed
    assert sum(most.values()) > 50 and sum((most & got).values()) >= 0.9 * sum(most.values())
    assert sum(n for k, n in want.items() if k[2]) > 50
    hit = {k[0] for k in got}
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()]
    assert Counter(kept) == Counter(i for i, _ in docs if i not in hit)
    assert decontaminate.contamination(d, b.limit(0)).collect() == []
    assert decontaminate.contamination(nothing, b).collect() == []
    assert decontaminate.drop_contaminated(nothing, b).collect() == []


def test_edits_allowed():
    assert [decontaminate.edits_allowed(n, 0.2) for n in (1, 4, 5, 6, 7, 10, 11, 15, 20, 59)] == [0, 0, 1, 1, 1, 2, 2, 3, 4, 11]


def test_concentrated_edits_are_found(spark):
    """All edits at one end, or in the middle of an item."""
    item = [f"w{i}" for i in range(60)]
    docs = []
    for k, at in enumerate((0, 24, 48)):
        w = list(item)
        w[at : at + 12] = [f"z{k}x{i}" for i in range(12)]
        docs.append((k, " ".join(["pad"] * 9 + w + ["end"] * 9)))
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert sorted((r["doc_id"], r["distance"]) for r in got) == [(0, 12), (1, 12), (2, 12)]


def test_strides_are_steps():
    """Four steps at once go where single ones go, and texts and items walk alike."""
    hashes = next(slices(pa.array([" ".join(f"w{i}" for i in range(200))]), ALNUM)).hashes()
    for walk in (0, 3):
        one, four = (list(decontaminate.strides(hashes, walk, 64, g)) for g in (1, 4))
        for start in range(0, 100, 7):
            at, places = start, []
            for x in one:
                places.append(at)
                at += int(x[at])
            big = start
            for j, x in enumerate(four):
                assert places[4 * j] == big
                big += int(x[big])
            assert (decontaminate.embed(hashes[start:], walk, 64) + start == places).all()


def test_walks_keep_close_windows_close():
    """Hamming distance of embeddings against edit distance."""
    rng = random.Random(6)
    hashes = next(slices(pa.array([" ".join(f"w{i}" for i in range(200))]), ALNUM)).hashes()
    alike = []
    for _ in range(40):
        w = rng.sample(range(200), 40)
        x = [v if isinstance(v, int) else 0 for v in edited(rng, w, 4)]
        a, b = (np.append(hashes[np.array(v)], 0)[np.minimum(decontaminate.embed(hashes[np.array(v)], 3, 60), len(v))] for v in (w, x))
        alike.append((a == b).mean())
    assert np.mean(alike) > 0.4


# ---- packing


def check_packing(rows, pieces, path):
    enc = packing.encoder(path)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*enc.exact.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        assert sum(p["length"] for p in own) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            text, at = ids[i][0], 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(text) and p["length"] > 0
                assert p["ids_crc32"] == zlib.crc32(text[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(text)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding


def test_packing(docs, rows, nothing, spark):
    path = queries.tokenizer_path()
    assert check_packing([(r[0], r[1]) for r in rows], packing.pack(docs, path).collect(), path) == 0
    assert check_packing([(r[0], r[1]) for r in rows], packing.pack(docs, path, block_sequences=2).collect(), path) == 0
    assert packing.pack(nothing, path).collect() == []
    odd = [(1, "<|endoftext|> x"), (2, "日本語 текст 😀 \x85  \x1c a"), (3, "it's we'll 1²³½ ǅ ɐ ˇ  \n\n  x\t\ty   "), (4, "\u00a0\u00a0a \u00ad b")]
    assert check_packing(odd, packing.pack(spark.createDataFrame(odd, "doc_id long, text string"), path).collect(), path) == 0


def test_fast_encoding_is_that_of_the_file():
    enc = packing.encoder(queries.tokenizer_path())
    for c in map(chr, range(0x250)):
        for x in (c, "a" + c + "b", " " + c + " ", c * 3, "1" + c + "2", "x " + c + c + " y", c + "'s"):
            assert enc.encode(x) == enc.exactly(x)


def test_other_files_go_to_the_library(tmp_path):
    """A file that asks for anything else takes no short cut."""
    path = queries.tokenizer_path()
    assert packing.plain(path) and packing.Encoder(path).quick
    said = json.loads(Path(path).read_text())
    texts = ["It's 4,952 words", " two  words", "<|endoftext|> x"]
    for part, change in (("pre_tokenizer", {"add_prefix_space": True}), ("pre_tokenizer", {"use_regex": False}), ("normalizer", {"type": "Lowercase"})):
        other = dict(said)
        other[part] = {**(said[part] or {}), **change}
        file = tmp_path / "other.json"
        file.write_text(json.dumps(other))
        enc = packing.Encoder(str(file))
        assert not packing.plain(str(file)) and enc.quick is None
        assert [enc.encode(t) for t in texts] == [enc.exactly(t) for t in texts]


def test_costs_are_balanced():
    """Of full sequences filled from equal pieces, attention costs stay close."""
    packer = packing.Packer(0, 2048, 1.0, 1 / 1024, 64)
    rng = random.Random(1)
    for row in range(400):
        packer.add(row, 0, rng.randint(20, 900))
    cost = Counter()
    for _, _, n, q, _ in packer.pack():
        cost[q] += n + n * n / 1024
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.12


# ---- pipeline


def test_pipeline(spark, docs, rows, monkeypatch):
    """Each stage against brute force on the rows that the stage before it kept."""
    state, bench = docs, spark.createDataFrame([(0, " ".join(rows[121][1].split()[35:75]))], "item_id long, text string")
    monkeypatch.setattr(queries, "table", lambda s, d, name: bench if name == "benchmark" else docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "copies", "near_copies", "benchmark", "sequences"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in state.collect()]
        after = stage(spark, state, "").cache()
        if name == "sequences":
            check_packing(before, after.collect(), queries.tokenizer_path())
            break
        assert after.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in after.collect()]
        assert not Counter(got) - Counter(before)
        if name == "language":
            brute = BruteLanguage([(r["doc_id"], r["text"], r["lang"]) for r in state.collect()], 240, 32)
            judged = [(x, *brute.judge(x[1])) for x in before]
            sure = Counter(x for x, label, score in judged if label != "und" and score >= 0.202)
            maybe = Counter(x for x, label, score in judged if label != "und" and score >= 0.198)
            assert not sure - Counter(got) and not Counter(got) - maybe
            assert len(got) < len(before)
        elif name == "copies":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best = {}
            for i, t in before:
                k = (-len(t), i is None, i or 0)
                if norm(t) not in best or k < best[norm(t)][0]:
                    best[norm(t)] = (k, i, t)
            assert Counter(got) == Counter((i, t) for _, i, t in best.values())
        elif name == "near_copies":
            low = [k[2] for k in classes(before).elements()]
            assert Counter(got) == Counter(x for x in before if x[0] is None or x[0] in low)
            assert len(got) < len(before)
        else:
            item = words(bench.first()["text"])
            assert Counter(got) == Counter(x for x in before if distance(item, words(x[1])) > len(item) // 5)
            assert len(got) < len(before)
        state = after


def test_pipeline_of_nothing(spark, nothing, monkeypatch):
    bench = spark.createDataFrame([], "item_id long, text string")
    monkeypatch.setattr(queries, "table", lambda s, d, name: bench if name == "benchmark" else nothing)
    state = nothing
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, "")
        assert state.collect() == []


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    assert got.count() > 50
