"""Word finding, hashing and packed arrays against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import blobs
from quirelake.llm.words import ALNUM, SPACED, polynomials, slices

TEXTS = ["A b  c", None, "", "é ü\tÉ\n", "one", " \x0b\x0c", "tail ", "a" * 5000 + " b", "x y z", "b c A b c", "A.b-c", "日本 語"]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
@pytest.mark.parametrize(("table", "pattern"), [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(limit, table, pattern):
    for column in (pa.array(TEXTS), pa.array(["skip", *TEXTS], pa.large_string())[1:], pa.chunked_array([TEXTS[:3], TEXTS[3:]])):
        got, grams = [], []
        for s in slices(column, table, limit=limit):
            h = s.hashes()
            words = [s.data[a:b].tobytes().decode() for a, b in zip(s.starts, s.ends, strict=True)]
            got += [words[a:b] for a, b in zip(s.words[:-1], s.words[1:], strict=True)]
            first, g = s.grams(3, h, short=True)
            at = dict(zip(first.tolist(), g.tolist(), strict=True))
            for a, b in zip(s.words[:-1].tolist(), s.words[1:].tolist(), strict=True):
                runs = [tuple(words[i : i + 3]) for i in range(a, b - 2)] or ([tuple(words[a:b])] if b > a else [])
                grams += zip(runs, [at[i] for i in range(a, max(b - 2, a + (b > a)))], strict=True)
        assert got == [re.findall(pattern, lower(t or "")) for t in TEXTS]
        assert len(dict(grams)) == len({g for _, g in grams})  # equal runs have equal hashes, others differ
        assert len(set(grams)) == len(dict(grams))


def thue_morse(n: int) -> str:
    """The pattern whose polynomials modulo a power of two vanish, from some hundred letters on."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_patterns_do_not_collide():
    for n in (64, 65, 512, 1024, 2048, 4096):
        x = thue_morse(n)
        for seed in (0, 1):
            h = next(slices(pa.array([" ".join((x, x.translate({97: 98, 98: 97}), x))]), SPACED)).hashes(seed)
            assert h[0] == h[2] != h[1]
    words = {0: "u", 1: "v"}
    for size in (5, 35):
        seen = set()
        for flip in (0, 1):
            t = " ".join(words[(bin(i).count("1") + flip) % 2] for i in range(64))
            s = next(slices(pa.array([t]), SPACED))
            runs = [t.split()[i : i + size] for i in range(64 - size + 1)]
            got = polynomials(s.hashes(), size, 1) if size > 5 else s.grams(size, s.hashes())[1]
            seen |= set(zip(map(tuple, runs), got.tolist(), strict=True))
        assert len(seen) == len({r for r, _ in seen}) == len({g for _, g in seen})


def test_seeds_are_independent():
    t = pa.array([" ".join(f"w{i}" for i in range(2000))])
    a, b = (next(slices(t, SPACED)).hashes(k) for k in (0, 1))
    assert len(set(a.tolist())) == len(set(b.tolist())) == 2000 and not set(a.tolist()) & set(b.tolist())


def test_polynomials_are_those_of_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 120, dtype=np.uint64) * np.uint64(2)
    prime = (1 << 61) - 1
    for size in (1, 2, 3, 34, 35, 64, 120, 121):
        got = polynomials(h, size, 7).tolist()
        assert len(got) == max(0, 121 - size)
        if got:
            base = int(polynomials(np.array([1, 0], np.uint64), 2, 7)[0])
            want = []
            for i in range(121 - size):
                v = 0
                for c in h[i : i + size].tolist():
                    v = (v * base + c) % prime
                want.append(v)
            assert got == want


def test_blocks_hold_all_rows_once(spark):
    rows = [(i % 7 if i % 3 else None, "x" * (i % 50)) for i in range(2000)] + [(1, "same")] * 500 + [(9, "long " * 5000), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    got = blobs.blocked(docs, ["doc_id", "text"], 3000, 5).collect()
    assert len({r["block"] for r in got}) == len(got) > 10
    back = []
    for r in got:
        t = blobs.opened(pa.table({"data": [bytes(r["data"])]}))
        assert sum(len(x or "") for x in t.column("text").to_pylist()) <= 3000 or t.num_rows == 1
        back += blobs.repeated(t.select(["doc_id", "text"]), t).to_pylist()
    assert Counter((x["doc_id"], x["text"]) for x in back) == Counter(rows)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 1 << 48), (5, 1 << 48), (50_000, 1 << 48), (50_000, 1 << 40), (50_000, 1 << 36), (50_000, 1 << 28)):
        keys = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (blobs.decode(blobs.encode(keys)) == keys).all()
        cut = blobs.cuts(keys, 7)
        assert cut[0] == 0 and cut[-1] == len(keys) and (np.diff(cut) >= 0).all()
    for counts in ([], [0, 1, 254, 255, 256, 10**12], [1, 300] * 900):
        assert (blobs.unpack(blobs.pack(np.array(counts, np.int64))) == np.array(counts, np.int64)).all()


def test_blocks_stay_near_linear():
    assert blobs.plan(0) == 8
    for total in (10**9, 10**12, 10**14):
        n = blobs.plan(total)
        assert total / n <= 129 << 20 and n <= max(8, total // (6 << 20) + 1)
