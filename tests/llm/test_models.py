"""Language identification, language model, personal data and URL filter: brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import language_id, lm_scoring, pii, queries, url_filter

SF = "/root/testdata/sf0.01"


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def bucket(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


# ---- language model


def less(n, d):
    return max(n - (0, *d)[min(n, 3)], 0)


class BruteTrigrams:
    """The model by its formulas, over dictionaries. Texts are lists of words; the end is 0, a start 1."""

    def __init__(self, texts):
        tri = Counter(x for w in texts for x in zip([1, 1, *w], [1, *w], w, strict=False))
        self.c, self.uni = tri, Counter(x for w in texts for x in w)
        self.left = Counter((v, w) for _, v, w in tri)
        self.seen = Counter(w for _, w in self.left)
        self.three = self.contexts({(u, v): [] for u, v, _ in tri}, ((k[:2], n) for k, n in tri.items()))
        self.two = self.contexts({v: [] for v, _ in self.left}, ((k[0], n) for k, n in self.left.items()))
        self.d3, self.d2, self.d1 = (lm_scoring.discounts([Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (tri, self.left, self.seen))

    @staticmethod
    def contexts(of, counts):
        for k, n in counts:
            of[k].append(n)
        return of

    @staticmethod
    def on(n, followers, d, below):
        if not followers:
            return below
        return less(n, d) / sum(followers) + sum(d[min(k, 3) - 1] for k in followers) / sum(followers) * below

    def p(self, u, v, w):
        if not self.c:
            return 1.0
        rest = sum(self.d1[min(n, 3) - 1] for n in self.seen.values())
        one = (less(self.seen[w], self.d1) + rest / (len(self.seen) + 1)) / len(self.left)
        two = self.on(self.left[v, w], self.two.get(v), self.d2, one)
        return self.on(self.c[u, v, w], self.three.get((u, v)), self.d3, two)

    def score(self, w):
        return sum(math.log10(self.p(*x)) for x in zip([1, 1, *w], [1, *w], w, strict=False))


def lm_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w] + [0]


def brute_scores(rows):
    words = [lm_words(r[1]) for r in rows]
    model = BruteTrigrams([w for w, r in zip(words, rows, strict=True) if bucket(r[0], 5) != 1])
    total, kinds = sum(model.uni.values()), len(model.uni)
    for r, w in zip(rows, words, strict=True):
        score = model.score(w)
        yield (
            r[0], bucket(r[0], 5) == 1, len(w), sum(model.uni[x] > 0 for x in w), total,
            sum(math.log10((model.uni[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), score, 10 ** (-score / len(w)),
        )


def lm_order(r):
    return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4))


@pytest.fixture(scope="module")
def scored(rows):
    return sorted(brute_scores(rows), key=lm_order)


@pytest.mark.parametrize("blocks", [1, 6])
def test_lm_scores(docs, scored, blocks, tmp_path):
    store = str(tmp_path / "model") if blocks > 1 else None
    got = sorted(map(tuple, lm_scoring.score(docs, queries.bucket("doc_id", 5) == 1, blocks=blocks, store=store).collect()), key=lm_order)
    assert [g[:5] for g in got] == [w[:5] for w in scored]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in scored], rtol=1e-9)
    if store:  # the stored model gives other workers the same scores
        again = sorted(map(tuple, lm_scoring.perplexity(docs, store).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 4)))
        want = sorted(scored, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 4)))
        assert [(g[0], *g[2:5]) for g in again] == [(w[0], *w[2:5]) for w in want]
        assert np.allclose([g[5:] for g in again], [w[5:] for w in want], rtol=1e-9)


def test_lm_repeated_rows_count_as_often_as_they_occur(spark):
    rows = [(1, "a b c a b")] * 700 + [(2, "a b d"), (3, "c a b d d")] + [(None, "a a b")] * 300
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), F.lit(False), blocks=2).collect()
    model = BruteTrigrams([lm_words(t) for _, t in rows])
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == Counter((i, round(model.score(lm_words(t)), 9)) for i, t in rows)


def test_lm_probabilities_of_all_continuations_sum_to_one(rows):
    model = BruteTrigrams([lm_words(r[1]) for r in rows[:40]])
    unknown = model.p(1, 1, "never seen")
    for u, v in ((1, 1), lm_words(rows[0][1])[:2], ("no", "such")):
        below = {w: model.p(u, v, w) for w in model.uni}
        assert math.isclose(sum(below.values()) + model.p(u, v, "never seen"), 1.0)
    assert unknown > 0


def test_lm_probabilities_sum_to_one():
    """The unigram level of the model, over all words and the unknown one."""
    seen = np.array([1, 1, 1, 2, 2, 3, 4, 9])
    e = lm_scoring.discounts([3, 2, 1, 1])
    rest = e[0] * 3 + e[1] * 2 + e[2] * 3
    assert np.isclose(((lm_scoring._less(seen, e) + rest / 9) / seen.sum()).sum() + rest / 9 / seen.sum(), 1.0)


def test_lm_beats_its_base(spark):
    got = queries.op3_lm_scoring(spark, SF).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.3


def test_lm_without_training(nothing, docs):
    assert lm_scoring.score(nothing, F.lit(False)).collect() == []
    assert {r["score"] for r in lm_scoring.score(docs, F.lit(True)).collect()} == {0.0}


# ---- language identification


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def symbols(text):
    out = []
    for c in text.lower():
        if "a" <= c <= "z":
            out.append(c)
        elif c.isspace():
            out.append(" ")
        else:
            out.append(ord(c) % 35 if c.isalpha() else "-")
    return out


def gram_set(text):
    s = symbols(text)
    return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


class BruteLanguage:
    """Nystroem features and kernel ridge regression over sets of n-grams."""

    def __init__(self, rows, per_label, landmarks, ridge=0.05):
        known = [r for r in rows if r[0] is not None and r[2] is not None and bucket(r[0], 3) != 1]
        order = lambda r: xxhash.xxh64_intdigest(str(r[0]).encode(), 42)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        best = {}
        for r in known:  # of rows with one id and label the smallest text
            k = (r[2], signed(order(r)))
            if k not in best or r[1] is not None and (best[k] is None or r[1] < best[k]):
                best[k] = r[1]
        sample = []
        for label in sorted({k[0] for k in best}):
            sample += [(label, best[k]) for k in sorted(k for k in best if k[0] == label)[:per_label] if best[k]]
        self.labels = sorted({x for x, _ in sample})
        sets = [gram_set(t) for _, t in sample]
        self.marks = []
        for label in self.labels:
            self.marks += [g for (x, _), g in zip(sample, sets, strict=True) if x == label][:landmarks]
        k = np.array([self.row(g) for g in self.marks])
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        x = np.array([self.row(g) for g in sets]) @ root
        y = np.array([[float(label == other) for other in self.labels] for label, _ in sample])
        w = (len(y) / len(self.labels) / y.sum(0))[y.argmax(1)][:, None]
        self.w = root @ np.linalg.solve(x.T @ (x * w) + ridge * np.eye(x.shape[1]), x.T @ (y * w))

    def row(self, g):
        return [len(g & m) / math.sqrt(len(g) * len(m)) for m in self.marks]

    def judge(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        f = np.array(self.row(gram_set(text))) @ self.w
        return self.labels[int(f.argmax())], min(max(float(f.max()), 0.0), 1.0)


def test_language_is_that_of_brute_force(spark, rows):
    """Landmarks, ridge regression and decisions, on the rows that hold all special cases."""
    texts = [r for r in rows if len(r[1] or "") < 2000]
    docs = spark.createDataFrame([(r[0], r[1], r[2], k) for k, r in enumerate(texts)], "doc_id long, text string, lang string, k int").repartition(3)
    model, brute = language_id.train(docs, queries.bucket("doc_id", 3) != 1, per_label=20, landmarks=5), BruteLanguage(texts, 20, 5)
    assert model.labels == brute.labels
    for r in language_id.predict(docs, model, ["k"]).collect():
        label, score = brute.judge(texts[r["k"]][1])
        assert abs(r["score"] - score) < 2e-3
        assert r["lang_pred"] == label or score == 0


def test_language_edges(docs, rows, nothing, spark):
    learn = queries.bucket("doc_id", 3) != 1
    model = language_id.train(docs, learn, per_label=20, landmarks=5)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert [got[i] for i in (500, 501, 502, 503)] == ["und"] * 4
    assert set(got.values()) <= {"en", "fr", "de", "es", "und"}
    odd = spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "½ a"), (4, "漢"), (5, "_ ٣")], "doc_id long, text string")
    assert [r["lang_pred"] != "und" for r in language_id.predict(odd, model, ["doc_id"]).orderBy("doc_id").collect()] == [False, False, True, True, False]
    assert language_id.train(nothing, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    assert language_id.known_language(clash, learn, per_label=20, landmarks=5).columns == clash.columns


def test_every_label_is_learned(spark):
    """Many labels, one of them with most rows, and rows that share an id."""
    rng = random.Random(9)
    rows = [(i, chr(97 + k % 26) * 3 + " " + chr(97 + k // 26) * 4 + " " + str(rng.random()), f"l{k:03d}") for k in range(90) for i in range(3 * k, 3 * k + 3)]
    rows += [(1000 + i, "common words here", "most") for i in range(3000)] + [(5000, f"one id {i % 7}", "same") for i in range(2000)] + [(None, "zz", "none")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.train(docs.repartition(n), F.lit(True)) for n in (2, 7))
    assert len(a.labels) == 92 and a.labels == b.labels and "none" not in a.labels
    assert (a.weights == b.weights).all()
    small = language_id.train(docs, F.lit(True), sample=100, all_landmarks=92)
    assert len(small.labels) == 92 and small.weights.shape[0] == 92


def test_kernel_is_exact():
    """The Nystroem map reproduces the kernel on its landmarks."""
    texts = ["the thing", "eau chon", "schung ei", "another thing"]
    grams = [language_id.presence(t) for t in texts]
    assert all(len(g) == len(set(g.tolist())) for g in grams)
    model = language_id.fit(grams, ["a", "b", "c", "a"], 4, 1e-6)
    assert [model.labels[k] for k in model.decide(grams).argmax(1)] == ["a", "b", "c", "a"]


# ---- personal data


def brute_spans(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, x):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or pii.luhn(d)):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        x = "".join(rng.choice("a1290.@+- ()_%b3\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(x) == brute_spans(x)


def test_personal_data(docs, rows, nothing):
    model = pii.train(docs)
    got = pii.personal_data(docs, model).collect()
    want = Counter()
    for r in rows:
        base = brute_spans(r[1] or "")
        n = Counter(k for k, _, _ in base)
        want[r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        base = {f"{k}:{a}:{b}" for k, a, b in brute_spans(next(x[1] for x in rows if x[0] == r["doc_id"]) or "")} if r["doc_id"] is not None else set()
        assert base <= set(r["spans"].split(",") if r["spans"] else [])
    assert pii.personal_data(nothing, pii.train(nothing)).collect() == []


def test_crf_learns_and_adds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = pii.train(docs.where(learned))
    texts = [r["text"] for r in docs.where(F.col("text").rlike("[0-9@]") & ~learned).select("text").collect()]  # held out
    both = total = secrets = found = 0
    for t in texts:
        base = set(pii.base_spans(t))
        own = {(pii.TYPES[y], r.at[i], r.at[j]) for r in pii.regions(t) for i, j, y in model.decode(r)}
        both, total = both + len(base & own), total + len(base)
        secret = {("secret", m.start(1), m.end(1)) for m in pii._ASSIGNED.finditer(t)}
        secrets, found = secrets + len(secret), found + len(secret & own)
    assert both > 0.9 * total
    assert found > 0.9 * secrets > 0


def test_crf_decoding_is_the_best_segmentation():
    """Dynamic programming against all segmentations of short regions, with random weights."""
    rng = np.random.default_rng(1)
    model = pii.SemiMarkov()
    model.span, model.single, model.move = (rng.normal(size=w.shape) for w in (model.span, model.single, model.move))
    for text in ("+1 22-3", "a@b.c1", "1.2.3.4", "(12) 7"):
        r = pii.Region(text, 0, len(text))
        single, known = r.outside @ model.single, {s: k for k, s in enumerate(r.segments)}

        def walk(at, last, r=r, single=single, known=known):
            if at == r.n:
                yield 0.0, []
            else:
                for score, rest in walk(at + 1, 0):
                    yield score + single[at] + model.move[last, 0], rest
                for (i, j), k in known.items():
                    if i == at:
                        for y in range(1, len(pii.TYPES)):
                            for score, rest in walk(j, y):
                                yield score + r.features[k] @ model.span[y - 1] + model.move[last, y], [(i, j, y), *rest]

        assert model.decode(r) == max(walk(0, len(pii.TYPES)), key=lambda x: x[0])[1]


# ---- URLs


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *(best or (None, None)))


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/x?y", "https://example.com/de/1#t", "http://x.org/fr", "http://x.org/fr/?a=1&b", "ftp://net/", "http://net", "http://planet/", "http://a.example.net/EN/", "http://a.b.net?x=/en/", "x://é.NET/ü", "http://u@h:1/p://q"]
    pages = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(urls * 2)], "page_id long, url string, host string, label int")
    got = {r["page_id"]: tuple(r)[1:6] for r in url_filter.judge_urls(pages, trees=2).collect()}
    for i, u in enumerate(urls * 2):
        host, path, rule, verdict = brute_url(u)
        assert got[i][:3] == (host, path, rule)
        assert got[i][3] == verdict or verdict is None and got[i][3] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), trees=2).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(pages.where("page_id < 4"), trees=2).collect()} == {"allow"}


def test_url_trees_on_held_out_urls(spark):
    """Labelled hosts that nothing was learned from: better than always saying the commoner verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.judge_urls(pages, learn="crc32(host) % 4 <> 0").where("rule is not null and crc32(host) % 4 = 0").collect()
    assert not {r["host"] for r in got} & {r["host"] for r in pages.selectExpr("parse_url(url, 'HOST') host").where("crc32(host) % 4 <> 0").collect()}
    blocked = np.mean([r["verdict"] == "block" for r in got])
    right = np.mean([(r["score"] >= 0.5) == (r["verdict"] == "block") for r in got])
    # the rules' verdicts hang on the language in the path, which lexical features do not show: 66 % against 61 %
    assert len(got) > 50 and right > max(blocked, 1 - blocked) + 0.02


def test_boosting_is_that_of_brute_force(spark):
    """Gradients, gains, splits and leaves over plain lists, with the same cuts."""
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        x = [float(rng.randrange(6)) for _ in url_filter.FEATURES]
        rows.append((int(x[0] + x[3] * 0.7 + rng.random() > 4.5), *x))
    names = ", ".join(f"{f} double" for f in url_filter.FEATURES)
    table = spark.createDataFrame(rows, f"label int, {names}")
    trees, depth, bins, rate, penalty = 3, 2, 4, 0.4, 1.0
    margin = url_filter.boost(table, trees, depth, bins, rate, penalty)
    shares = ",".join(f"{k / bins}D" for k in range(1, bins))
    cuts = [sorted(set(table.agg(F.expr(f"percentile_approx({f}, array({shares}), 10000)")).first()[0])) for f in url_filter.FEATURES]
    y = [r[0] for r in rows]
    x = [r[1:] for r in rows]
    z = [math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in z]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            grown = []
            for node in nodes:
                gs, hs = sum(g[i] for i in node), sum(h[i] for i in node)
                best = (1e-6, None)
                for f, edges in enumerate(cuts):
                    for e in edges:
                        low, high = [i for i in node if x[i][f] <= e], [i for i in node if x[i][f] > e]
                        if low and high:
                            gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                            gain = gl * gl / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs * gs / (hs + penalty)
                            if gain > best[0] + 1e-9:
                                best = (gain, (low, high))
                grown += best[1] or [node]
            nodes = grown
        for node in nodes:
            for i in node:
                z[i] += -rate * sum(g[k] for k in node) / (sum(h[k] for k in node) + penalty)
    got = table.select(F.monotonically_increasing_id().alias("k"), margin.alias("z")).orderBy("k").collect()
    assert np.allclose([r["z"] for r in got], z, rtol=1e-6)


def test_own_labels_do_not_reach_own_features(spark):
    """Suffixes that one URL each has: its label must not be read from its suffix."""
    pages = spark.createDataFrame([(i, f"http://h{i}.d{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr'}/") for i in range(400)], "page_id long, url string")
    rules = [("block", f"d{i}.net/") for i in range(1, 400, 4)] + [("allow", f"d{i}.net/") for i in range(3, 400, 4)]
    got = url_filter.judge_urls(pages, rules=rules, trees=4).where("rule is not null").collect()
    right = np.mean([(r["score"] >= 0.5) == (r["verdict"] == "block") for r in got])
    assert len(got) == 200 and right < 0.75
