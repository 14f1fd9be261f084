"""Functions that SQL cannot express, as Arrow UDFs: one worker call a batch, never a row at a time."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType

#: Names that some systems keep for devices.
RESERVED = {"CON", "PRN", "AUX", "NUL"} | {f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)}


def ratio(a: str, b: str) -> float:
    """Similarity by matching blocks; not symmetric, and no edit distance."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def bounded_ratio(a: str, b: str, cut: float) -> float:
    """The ratio where it can reach the cut; by lengths alone it is at most 2 * min / (sum), and it matches no more than the characters
    that both have."""
    total = len(a) + len(b)
    if total and (2.0 * min(len(a), len(b)) / total < cut or 2.0 * _common(_bag(a), _bag(b)) / total < cut):
        return 0.0
    return ratio(a, b)


_PLACES, _MOST = 64, 32


@lru_cache(1024)
def _bag(text: str) -> tuple[int, int]:
    """A bit for each character and time that it occurs, in 64 places of 32 bits each; and how many found no room."""
    counts = [0] * _PLACES
    bits = over = 0
    for c, n in Counter(text).items():
        place = ord(c) % _PLACES
        had = counts[place]
        counts[place] = now = had + n
        if now > _MOST:
            over += now - max(had, _MOST)
            now = _MOST
        if now > had:
            bits |= ((1 << now) - 1) << place * _MOST
    return bits, over


def _common(a: tuple[int, int], b: tuple[int, int]) -> int:
    """At least as many as the characters, with repeats, that two texts share."""
    return (a[0] & b[0]).bit_count() + min(a[1], b[1])


@arrow_udf(DoubleType())
def seq_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def char_share(reference: str | None, candidate: str | None) -> float:
    """Share of the reference's characters, with repeats, that the candidate has."""
    have, other = Counter(reference or ""), Counter(candidate or "")
    if not have:
        return 0.0 if other else 1.0
    return sum(min(n, other[c]) for c, n in have.items()) / have.total()


@arrow_udf(DoubleType())
def char_coverage(reference: pa.Array, candidate: pa.Array) -> pa.Array:
    """Higher-order functions would go through the text once for each distinct character."""
    return pa.array([char_share(a, b) for a, b in zip(reference.to_pylist(), candidate.to_pylist(), strict=True)], pa.float64())


def safe_name(value: str | None, fallback: str = "content", longest: int = 180) -> str:
    """The last part of a path, without characters that file systems refuse."""
    name = re.split(r"[\\/]", unicodedata.normalize("NFKC", value or ""))[-1]
    name = re.sub(r'[<>:"|?*]', "_", re.sub(r"[\x00-\x1f\x7f]", "", name)).strip(" .") or fallback
    head, dot, tail = name.rpartition(".")
    stem, suffix = (head, dot + tail.lower()) if head else (name, "")
    stem, suffix = stem.strip(" .") or fallback, suffix[:16]
    if stem.upper() in RESERVED:
        stem = "_" + stem
    return stem[: max(1, longest - len(suffix))] + suffix


@arrow_udf(StringType())
def safe_filename(x: pa.Array) -> pa.Array:
    return pa.array([safe_name(v) for v in x.to_pylist()], pa.string())


@arrow_udf(StringType())
def unescape(x: pa.Array) -> pa.Array:
    """HTML character references."""
    import html

    return pa.array([None if v is None else html.unescape(v) for v in x.to_pylist()], pa.string())
