"""Exact, substring and near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quirelake.llm import exact_dedup, ngram_join, substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def copies(rows, digest):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    want = Counter()
    for text, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            want[m[3], members[0][3], len(members), k == 0, digest(text)] += 1
    return want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup(docs, rows):
    for salts in (1, 16):
        assert bag(exact_dedup.exact_dedup(docs, salts=salts).collect()) == copies(rows, sha)


def test_exact_dedup_where_texts_share_a_digest(docs, rows):
    """A digest of one byte: content decides."""
    short = lambda c: F.substring(exact_dedup.sha256(c), 1, 1)
    assert bag(exact_dedup.exact_dedup(docs, digest=short).collect()) == copies(rows, lambda t: sha(t)[:2])
    assert len({k[4] for k in copies(rows, lambda t: sha(t)[:2])}) < len({k[4] for k in copies(rows, sha)})
    assert bag(exact_dedup.drop_copies(docs, digest=short).select("doc_id", "text").collect()) == bag(exact_dedup.drop_copies(docs).select("doc_id", "text").collect())


def test_exact_dedup_of_many_repeated_rows(spark):
    rows = [(1, "a b")] * 9000 + [(1, "a  b"), (2, "ab"), (None, "ab")] + [(None, None)] * 20
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert bag(got.collect()) == copies(rows, sha)


def test_drop_copies_keeps_the_longest_original(spark):
    rows = [(7, "a b", 1), (7, "a    b", 2), (7, "a b", 3), (8, "c\td", 4), (8, "c d", 5), (None, "e", 6), (9, None, 7), (3, " ", 8)]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    assert bag(got) == Counter([(7, "a    b", 2), (8, "c\td", 4), (None, "e", 6), (3, " ", 8)])


def test_exact_dedup_keeps_rows(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in kept.collect()]
    assert Counter(texts) == Counter({SPACE.sub("", r[1] or "") for r in rows})


def test_substring_dedup(docs, rows):
    split = [SPACE.split(r[1] or "") for r in rows]
    split = [[w for w in s if w] for s in split]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for blocks in (1, 9):
        got = substring_dedup.substring_dedup(docs, blocks=blocks)
        assert bag(got.drop("intervals").collect()) == want
    for r in got.collect():
        assert sum(x["end"] - x["start"] for x in r["intervals"]) == r["n_removed"]
    assert sum(n for (_, _, removed, _), n in want.items() if removed) > 10


def shingles(t: str | None) -> frozenset:
    w = [x for x in SPACE.split(lower(t or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows) -> Counter:
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((r[0], len(sets[i]), low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_classes(docs, rows):
    for blocks in (1, 7):
        assert bag(ngram_join.jaccard_classes(docs, blocks=blocks).collect()) == classes(rows)


def test_jaccard_classes_of_random_neighbours(spark):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base[: rng.choice((40, 50, 60))])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice((f"x{rng.randrange(9)}", f"y{i}"))
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), blocks=3)
    assert bag(got.collect()) == classes(rows)


def test_patterned_words_are_told_apart(spark):
    """Words that collide under polynomial hashes modulo powers of two."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        y = x.translate({97: 98, 98: 97})
        rest = [f"w{k}x{i}" for i in range(17)]
        rows += [(10 * k, " ".join([*rest, x, *rest])), (10 * k + 1, " ".join([*rest, y, *rest])), (10 * k + 2, x), (10 * k + 3, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(docs, blocks=2).collect()} == {0}
    got = ngram_join.jaccard_classes(docs, blocks=2).collect()
    assert bag(got) == classes(rows)
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_repeated_rows_come_out_as_often(spark):
    rows = [(7, "one two three four five six")] * 400 + [(None, "seven")] * 300 + [(1, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert bag(ngram_join.jaccard_classes(docs, blocks=2).collect()) == Counter({(7, 2, 7): 400, (None, 1, None): 300, (1, 1, 1): 1})
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text)] * 50 + [(8, "w1 w2")], "doc_id long, text string").coalesce(1)
    assert Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs, blocks=1).collect()) == Counter({(7, 40): 50, (8, 0): 1})


def test_one_of_each(docs, rows):
    want = {r[2] for r in classes(rows) if r[2] is not None}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == want


def test_empty_tables(nothing):
    for f in (exact_dedup.exact_dedup, exact_dedup.drop_copies, substring_dedup.substring_dedup, ngram_join.jaccard_classes, ngram_join.one_of_each):
        assert f(nothing).collect() == []
