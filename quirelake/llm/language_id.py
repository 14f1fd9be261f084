"""Language ID: string-kernel classification with Nystroem landmarks and kernel ridge regression.

The kernel is the blended spectrum of n-gram presence: two texts compare by how many n-grams of
1 to 3 symbols both have, divided by the root of the product of their numbers of n-grams.
Symbols are a-z, white space and everything else that is no letter (one symbol each), and 35
classes of other letters by code point, so an n-gram is a number below 2**18.

Training (on the driver, from a bounded sample): of each label, the rows with the smallest hashed
ids, at most ``per_label`` and so many that all labels together stay near ``sample`` rows, are
turned into presence sets by the executors (32 kB at most each). Every label is learned, however rare. Landmarks
of each label, at most ``landmarks`` and ``all_landmarks`` together (but one at least), give the Nystroem map
K(x, L) K(L, L)^(-1/2); one ridge regression per label against the rest is solved on it.

Scoring streams over the table: presence matrices of small batches of whole texts are multiplied
with the landmarks' matrix and then with the weights. Nothing is shuffled.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if
no labelled row can be learned from; of labels that score alike the first in order is taken; rows with a null label or
a null id are not learned from; of rows with one id and label the smallest text is; a very long text is judged whole;
repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_SIZE = 1 << 18
#: Letters, and some numbers that are no decimal digits.
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def _symbols() -> np.ndarray:
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if "a" <= x <= "z":
            table[c] = c - 96
        elif x.isspace():
            table[c] = 27
        elif x.isalpha():
            table[c] = 28 + 1 + c % 35
        else:
            table[c] = 28
    return table


_table: list[np.ndarray] = []


def presence(text: str) -> np.ndarray:
    """The distinct n-grams of 1 to 3 symbols, sorted."""
    if not _table:
        _table.append(_symbols())
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _table[0][np.minimum(raw, 0xFFFF)]
    for i in np.flatnonzero(raw > 0xFFFF).tolist():
        c = int(raw[i])
        s[i] = 29 + c % 35 if chr(c).isalpha() else 28
    seen = np.zeros(_SIZE, bool)
    seen[s] = True  # 1-grams are below 64; longer ones begin with a symbol over 0
    if len(s) > 1:
        two = s[:-1] << 6 | s[1:]
        seen[two] = True
        if len(s) > 2:
            seen[two[:-1] << 6 | s[2:]] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    labels: list[str]
    place: np.ndarray  # n-gram -> column of the landmarks' matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, each landmark divided by the root of its size
    weights: np.ndarray  # landmarks x labels, with the Nystroem map multiplied in

    def decide(self, grams: list[np.ndarray]) -> np.ndarray:
        """Decision values for each label."""
        x = np.zeros((len(grams), len(self.landmarks)), np.float32)
        for i, g in enumerate(grams):
            c = self.place[g]
            x[i, c[c >= 0]] = 1.0 / np.sqrt(max(len(g), 1))
        return (x @ self.landmarks) @ self.weights


def fit(grams: list[np.ndarray], labels: list[str], per_label_landmarks: int, ridge: float) -> Model:
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(y == k)[:per_label_landmarks] for k in range(len(names))])
    vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
    place = np.full(_SIZE, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[place[grams[i]], k] = 1.0 / np.sqrt(max(len(grams[i]), 1))
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    model = Model(names, place, marks, np.eye(len(chosen), dtype=np.float32))
    features = np.concatenate([model.decide(grams[i : i + 64]) for i in range(0, len(grams), 64)]) @ root
    targets = (y[:, None] == np.arange(len(names))).astype(float)
    share = 1.0 / np.maximum(targets.sum(0), 1)
    w = share[y] * len(y) / len(names)  # each label weighs the same
    gram = features.T @ (features * w[:, None])
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), features.T @ (targets * w[:, None]))
    model.weights = (root @ solved).astype(np.float32)
    return model


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = 240,
    sample: int = 4096,
    landmarks: int = 32,
    all_landmarks: int = 1024,
    ridge: float = 0.05,
) -> Model | None:
    """Fits on the rows for which ``learn`` holds and neither label nor id is null."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    labels = rows.select("label").distinct().count()
    if not labels:
        return None
    most, marks = max(1, min(per_label, sample // labels)), max(1, min(landmarks, all_landmarks // labels))
    # a label's smallest hashes, first in 32 parts of it, then in 4, so that a label that most rows have is no task of its own
    keys = rows.select("h", "label").distinct()
    for parts in (32, 4, 1):
        part = Window.partitionBy("label", F.pmod("h", F.lit(parts))).orderBy("h")
        keys = keys.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most).drop("r")
    chosen = {(r["label"], r["h"]) for r in keys.collect()}
    some = rows.where(F.col("h").isin([h for _, h in chosen])).join(F.broadcast(keys), ["h", "label"], "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [_packed(presence(t.as_py() or "")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grams, pa.binary())], names=["h", "label", "grams"])

    found = some.groupBy("h", "label").agg(F.min("text").alias("text")).mapInArrow(sets, "h long, label string, grams binary").collect()
    got = sorted((r["label"], r["h"], bytes(r["grams"])) for r in found)
    grams = [_unpacked(x[2]) for x in got]
    kept = [k for k, g in enumerate(grams) if len(g)]
    return fit([grams[k] for k in kept], [got[k][0] for k in kept], marks, ridge) if kept else None


def _packed(grams: np.ndarray) -> bytes:
    """A set of n-grams: numbers, or a bit for each, whichever is shorter."""
    if len(grams) * 4 < _SIZE // 8:
        return b"n" + grams.tobytes()
    bits = np.zeros(_SIZE, bool)
    bits[grams] = True
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    if x[:1] == b"n":
        return np.frombuffer(x, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, offset=1))).astype(np.int32)


def judge(model: Model | None, texts: list[str | None], step: int = 32) -> tuple[list[str], list[float]]:
    """Labels and scores of whole texts."""
    label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return label, score
    some = [i for i, t in enumerate(texts) if t and has_letter(t)]
    for k in range(0, len(some), step):
        part = some[k : k + step]
        f = model.decide([presence(texts[i]) for i in part])
        for i, best, v in zip(part, f.argmax(1).tolist(), f.max(1).tolist(), strict=True):
            label[i], score[i] = model.labels[best], min(max(v, 0.0), 1.0)
    return label, score


def predict(docs: DataFrame, model: Model | None, keep: list, text_col: str = "text") -> DataFrame:
    """The columns of keep, with lang_pred and score."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: all_landmarks columns (or one for each label) of at most 2**18 n-grams
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                label, score = judge(sent.value, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(label, pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"],
                )

    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, learn: Column, text_col: str = "text", least: float = 0.2, **options) -> DataFrame:
    """The documents whose language is recognised, with their own columns. Those without letters go, and those
    for which no language's decision value reaches ``least`` (one for the right language, zero for the others)."""
    model = train(docs, learn, text_col=text_col, **options)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    marked = predict(whole, model, ["row"])
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
