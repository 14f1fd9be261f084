"""PII: patterns, and a semi-Markov conditional random field over candidate regions.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers (see base_spans). The model
adds spans that the patterns cannot: credentials assigned in running text, and whatever whole-span
evidence makes likely.

Regions are runs of neighbouring chunks (between white space) that hold a digit or an at sign. A
region's tokens are runs of ASCII letters and digits, and single other characters. The model
scores whole segments of up to ``BOUND`` tokens by features of the span (digits, separators,
checksum, hexadecimal length, what stands around it) for each type, with transitions between
types; single tokens are otherwise outside. Training maximises the conditional likelihood by
forward-backward sums over all segmentations; decoding is bounded-entity dynamic programming that
chooses boundaries and types jointly.

It is trained on at most ``regions`` regions of at most ``sample`` documents (those with the
smallest hashed ids among documents with digits or at signs; of rows with one id, the smallest text), labelled by the patterns and by an
assignment rule for credentials (distant supervision). Scoring streams over the table.

Defined results: null and empty texts have no spans; positions are code points; spans of the
model that overlap a pattern's are dropped; of segmentations that score alike the first found is taken; a very long
text is searched whole, a long region in steps; repeated rows are reported each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.words import _buffers

KINDS = ("email", "ip", "card", "phone")
TYPES = ("outside", *KINDS, "secret")
BOUND = 20
#: Tokens whose segments are held in memory at once.
STEP = 512
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits: after one ends, no digit follows
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key|key)\s*[=:]\s*[\"']?([0-9A-Za-z]{16,})")
_REGION = re.compile(r"\S*[0-9@]\S*(?:[ \t]\S*[0-9@]\S*)*")
_TOKEN = re.compile(r"[0-9A-Za-z]+|[^0-9A-Za-z]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[0x30:0x3A] = _TRIGGER[0x40] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(x: str) -> str:
    return x.translate({32: None, 40: None, 41: None, 43: None, 45: None, 46: None})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, leftmost and non-overlapping within a kind, by kind and start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", free)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Region:
    """Tokens of a region and the features of its candidate segments."""

    def __init__(self, text: str, start: int, end: int):
        self.at = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
        self.tokens = [text[a:b] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        self.before = text[max(0, start - 24) : start].lower()
        self.n = len(self.tokens)
        self.outside = np.array([self.single(t) for t in self.tokens])

    @cached_property
    def segments(self) -> list[tuple[int, int]]:
        return self.ending(0, self.n)

    @cached_property
    def features(self) -> np.ndarray:
        return self.spans(self.segments)

    def ending(self, low: int, high: int) -> list[tuple[int, int]]:
        """Candidate segments that end after token low, and not after high, by start and end."""
        found = [
            (i, j) for i in range(max(0, low + 1 - BOUND), high) if self.tokens[i][0] in "+(" or self.tokens[i].isalnum()
            for j in range(max(i, low) + 1, min(high, i + BOUND) + 1) if self.tokens[j - 1].isascii() and self.tokens[j - 1].isalnum()
        ]
        return [(i, j) for i, j in found if any("0" <= c <= "9" or c == "@" for t in self.tokens[i:j] for c in t)]

    def spans(self, segments: list[tuple[int, int]]) -> np.ndarray:
        return np.array([self.span(i, j) for i, j in segments]).reshape(len(segments), WIDTH)

    def single(self, t: str) -> list[float]:
        return [1.0, t.isalnum(), t.isdigit(), t == "@", len(t) >= 9 and t.isdigit(), len(t) >= 16]

    def span(self, i: int, j: int) -> list[float]:
        part = self.tokens[i:j]
        text = "".join(part)
        digits = "".join(c for c in text if "0" <= c <= "9")
        n, letters = len(digits), any(c.isalpha() for c in text)
        left = self.tokens[i - 1] if i else " "
        right = self.tokens[j] if j < self.n else " "
        own = "".join(self.tokens[max(0, i - 6) : i])
        near = (self.before + own)[-24:].lower()
        numbers = text.split(".")
        alike = len(part) == 1
        return [
            1.0, len(part) / 10, n < 7, 7 <= n < 9, 9 <= n <= 12, 13 <= n <= 19, n > 19, letters,
            text.count("@") == 1, "@" in text and "." in text.partition("@")[2] and part[-1].isalnum(), part[0] == "+",
            len(numbers) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in numbers),
            text.isdigit(), 13 <= n <= 19 and not letters and luhn(digits), alike and len(text) >= 16 and letters,
            alike and len(text) >= 16 and all(c in "0123456789abcdefABCDEF" for c in text),
            " " in text, "(" in text or "-" in text, "." in text, left in " \t\"'(=:<,;", right in " \t\"')>,;.!?",
            left.isalnum() or left in "._%+-@", right in "@-" or right.isalnum(), any(w in near for w in ("token", "secret", "passw", "key")), "=" in near or ":" in near,
            left in "\"'" and right in "\"'",
        ]

    def gold(self, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]] | None:
        """(first token, token after, type) of labelled spans inside; None where one does not fit the tokens."""
        out, known = [], {s: k for k, s in enumerate(self.segments)}
        for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
            if b <= self.at[0] or a >= self.at[-1] or out and a < self.at[out[-1][1]]:
                continue
            if a not in self.at or b not in self.at or (self.at.index(a), self.at.index(b)) not in known:
                return None
            out.append((self.at.index(a), self.at.index(b), TYPES.index(kind)))
        return out


WIDTH, SINGLE = 26, 6


class SemiMarkov:
    """Weights of segments by type, of outside tokens, and of transitions."""

    def __init__(self, seed: int = 0):
        self.span = np.zeros((len(TYPES) - 1, WIDTH))
        self.single = np.zeros(SINGLE)
        self.move = np.zeros((len(TYPES) + 1, len(TYPES)))  # the last row: from the region's start

    def arcs(self, r: Region) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each end: (start, segment or -1, score of each type)."""
        into: list[list] = [[] for _ in range(r.n + 1)]
        none = np.full(len(TYPES) - 1, -np.inf)
        single = r.outside @ self.single
        for j in range(1, r.n + 1):
            into[j].append((j - 1, -1, np.append(single[j - 1], none)))
        if r.segments:
            s = r.features @ self.span.T
            for k, (i, j) in enumerate(r.segments):
                into[j].append((i, k, np.append(-np.inf, s[k])))
        return into

    def decode(self, r: Region) -> list[tuple[int, int, int]]:
        """The best segmentation of the whole region; features are made for ``STEP`` tokens at a time."""
        t = len(TYPES)
        best = np.full((r.n + 1, t + 1), -np.inf)
        best[0, t] = 0.0
        back = np.zeros((r.n + 1, t, 2), np.int64)
        single = r.outside @ self.single
        none = np.full(t - 1, -np.inf)
        for low in range(0, r.n, STEP):
            high = min(low + STEP, r.n)
            into = [[(j - 1, np.append(single[j - 1], none))] for j in range(low + 1, high + 1)]
            segments = r.segments if r.n <= STEP else r.ending(low, high)
            if segments:
                features = r.features if r.n <= STEP else r.spans(segments)
                for (i, j), score in zip(segments, features @ self.span.T, strict=True):
                    into[j - low - 1].append((i, np.append(-np.inf, score)))
            for j, arcs in enumerate(into, low + 1):
                for i, score in arcs:
                    come = best[i][:, None] + self.move
                    last = come.argmax(0)
                    total = come[last, np.arange(t)] + score
                    for y in np.flatnonzero(total > best[j, :t]).tolist():
                        best[j, y] = total[y]
                        back[j, y] = (i, last[y])
        out, j, y = [], r.n, int(best[r.n].argmax())
        while j:
            i, before = back[j, y].tolist()
            if y:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def gradient(self, r: Region, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log-likelihood: what is seen less what is expected."""
        into, t = self.arcs(r), len(TYPES)
        alpha = np.full((r.n + 1, t + 1), -np.inf)
        alpha[0, t] = 0.0
        add = np.logaddexp
        for j in range(1, r.n + 1):
            for i, _, score in into[j]:
                alpha[j, :t] = add(alpha[j, :t], add.reduce(alpha[i][:, None] + self.move, axis=0) + score)
        z = add.reduce(alpha[r.n])
        beta = np.full((r.n + 1, t + 1), -np.inf)
        beta[r.n] = 0.0
        g_span, g_single, g_move = np.zeros_like(self.span), np.zeros_like(self.single), np.zeros_like(self.move)
        for j in range(r.n, 0, -1):
            for i, k, score in into[j]:
                onward = self.move + (score + beta[j, :t])[None, :]
                beta[i] = add(beta[i], add.reduce(onward, axis=1)) if i else beta[i]
                share = np.exp(alpha[i][:, None] + onward - z)
                g_move -= share
                if k < 0:
                    g_single -= share[:, 0].sum() * r.outside[j - 1]
                else:
                    g_span -= share[:, 1:].sum(0)[:, None] * r.features[k]
        known, last, j = {s: k for k, s in enumerate(r.segments)}, t, 0
        path = []
        for a, b, y in [*gold, (r.n, r.n, 0)]:
            path += [(x, x + 1, 0) for x in range(j, a)]
            if b > a:
                path.append((a, b, y))
            j = b
        for a, b, y in path:
            g_move[last, y] += 1
            if y:
                g_span[y - 1] += r.features[known[a, b]]
            else:
                g_single += r.outside[a]
            last = y
        return g_span, g_single, g_move

    def fit(self, data: list[tuple[Region, list]], epochs: int = 4, rate: float = 0.3) -> SemiMarkov:
        weights = (self.span, self.single, self.move)
        sums = [np.full(w.shape, 1e-6) for w in weights]
        order = np.random.Generator(np.random.PCG64(7))
        for _ in range(epochs):
            for k in order.permutation(len(data)):
                for w, g, s in zip(weights, self.gradient(*data[k]), sums, strict=True):
                    g = g - 1e-4 * w
                    s += g * g
                    w += rate * g / np.sqrt(s)
        return self


def regions(text: str) -> Iterator[Region]:
    """Each run of chunks whole, however long it is."""
    for m in _REGION.finditer(text):
        yield Region(text, m.start(), m.end())


def labelled(text: str, limit: int) -> list[tuple[Region, list]]:
    spans = base_spans(text) + [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]
    out = []
    for r in regions(text):
        gold = r.gold(spans)
        if gold is not None:
            out.append((r, gold))
        if len(out) >= limit:
            break
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 300, regions_most: int = 500) -> SemiMarkov:
    """Fits on labelled regions of a bounded sample. Executors cut the texts down to the regions' surroundings."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    # which documents first; only theirs are cut
    first = [r[0] for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    # surroundings of digits and at signs only, so that the size of a sampled text is bounded
    near = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\n]{0,60}[0-9@]\S{0,80}(?:[ \t]\S{0,40}[0-9@]\S{0,40}){0,6})"), F.lit(1)), 1, 8), "\n")
    got = rows.where(F.col("h").isin(first)).select("h", near.alias("near")).groupBy("h").agg(F.min("near").alias("near")).orderBy("h").collect() if first else []
    data: list = []
    for r in got:
        data += labelled(r["near"], regions_most - len(data))
        if len(data) >= regions_most:
            break
    return SemiMarkov().fit(data)


def find(text: str, model: SemiMarkov, known: dict) -> tuple[list, list]:
    """(pattern spans, all spans)."""
    base = base_spans(text)
    more = []
    for r in regions(text):
        key = (r.before, tuple(r.tokens)) if r.at[-1] - r.at[0] <= 200 else None  # long ones are not remembered
        got = known.get(key)
        if got is None:
            got = model.decode(r)
            if key:
                if len(known) > 20_000:
                    known.clear()
                known[key] = got
        more += [(TYPES[y], r.at[i], r.at[j]) for i, j, y in got]
    taken = sorted((a, b) for _, a, b in base)
    free = [x for x in more if not any(a < x[2] and x[1] < b for a, b in taken)]
    rank = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return base, sorted(base + free, key=lambda x: (rank[x[0]], x[1], x[2]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of pattern spans, their digest, and all spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            n = b.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            texts = b.column(1)
            off, data = _buffers(texts)
            hits = np.flatnonzero(_TRIGGER[data[off[0] : off[-1]]]) + off[0]
            for i in np.unique(np.searchsorted(off, hits, "right") - 1).tolist():
                base, every = find(texts[i].as_py() or "", model, known)
                for k, kind in enumerate(KINDS):
                    counts[k, i] = sum(x[0] == kind for x in base)
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(every)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
