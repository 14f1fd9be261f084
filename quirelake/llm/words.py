"""Vectorised word and n-gram hashing over Arrow string buffers.

Texts are read straight from Arrow's UTF-8 buffers, in slices of about a megabyte, so memory
stays bounded however long a batch is (one text longer than a slice makes a slice of its own).
A word's 64-bit hash mixes its length and its bytes, eight at a time; no step is linear, so no text
is built to collide by its pattern alone. Each seed gives a hash of its own. Short runs of words mix
the words' hashes in order; long windows take Rabin-Karp polynomials modulo 2**61 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
#: Words of more bytes than this are hashed one by one.
_LONG = 64
_PRIME = (1 << 61) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of bytes outside ASCII white space [\x20\x09-\x0D].
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words are runs of [0-9a-z] (after lower-casing) and of anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _seeded(seed: int) -> tuple[np.uint64, np.uint64]:
    """An odd factor and a first state of a seed."""
    x = mix(np.array([2 * seed + 1, 2 * seed + 2], np.uint64) * _U(_P))
    return x[0] | _U(1), x[1]


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    factor, first = _seeded(seed)
    size = ends - starts
    out = mix(size.astype(np.uint64) * factor + first)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    some, k = np.flatnonzero(size <= _LONG), 0
    while len(some):
        left = size[some] - k
        out[some] = mix(out[some] * factor + (eight[starts[some] + k] & _MASKS[np.minimum(left, 8)]))
        some, k = some[left > 8], k + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed + 1)
    return out


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2**61 - 1; both are below that."""
    low, high = _U(0x7FFFFFFF), _U(31)
    a0, a1, b0, b1 = a & low, a >> high, _U(b & 0x7FFFFFFF), _U(b >> 31)
    mid = a1 * b0 + a0 * b1
    return _fold(a1 * b1 * _U(2) + (mid >> _U(30)) + ((mid & _U(0x3FFFFFFF)) << high) + a0 * b0)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def polynomials(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**61 - 1, of the windows of so many consecutive hashes: one for each start
    that has a whole window. Windows of twice the size are put together from two of the size before."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    base = int(_seeded(seed)[1]) % (_PRIME - 256) + 256
    level, width, done, have = _fold(hashes), 1, None, 0
    while True:
        if size & width:
            done = level if done is None else _fold(_times(level[: len(hashes) - have - width + 1], pow(base, have, _PRIME)) + done[width:])
            have += width
        if have == size:
            return done
        level = _fold(_times(level[:-width], pow(base, width, _PRIME)) + level[width:])
        width *= 2


@dataclass
class Slice:
    """Some consecutive texts of a batch: rows first..first+n-1."""

    first: int
    n: int
    data: np.ndarray  # bytes, lower-cased if asked for
    bounds: np.ndarray  # n+1 byte offsets into data
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    words: np.ndarray  # n+1 indexes of words: those of text i are words[i]..words[i+1]-1

    def counts(self) -> np.ndarray:
        return np.diff(self.words)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash for each word; seeds give independent ones."""
        return _words(self.data, self.starts, self.ends, seed)

    def starts_of(self, size: int) -> np.ndarray:
        """The first word of each run of size words that lies in one text."""
        last = np.repeat(self.words[1:], self.counts())  # word index after the text, for each word
        return np.flatnonzero(np.arange(len(last)) + size <= last)

    def grams(self, size: int, hashes: np.ndarray, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of size words that lies in one text.
        short: a text with fewer words, but at least one, gives all its words as one run."""
        first = self.starts_of(size)
        got = run_hashes(hashes, first, size)
        if short:
            count = self.counts()
            firsts, runs = [first], [got]
            for k in range(1, size):
                few = self.words[:-1][count == k]
                firsts.append(few)
                runs.append(run_hashes(hashes, few, k))
            first, got = np.concatenate(firsts), np.concatenate(runs)
            order = np.argsort(first, kind="stable")
            first, got = first[order], got[order]
        return first, got


def run_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size hashes from each first one on, in order; the size is mixed in."""
    got = np.full(len(first), mix(np.array([size * _P % (1 << 64)], np.uint64))[0])
    for k in range(size):
        got = mix(got * _U(0x9FB21C651E98DF25) + hashes[first + k])
    return got


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len+1) and bytes of a string array; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array | pa.ChunkedArray, word: np.ndarray = SPACED, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut the texts of a column into slices and find their words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    off, data = _buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        bounds = off[i : j + 1] - off[i]
        raw = data[off[i] : off[j]]
        if lower:
            raw = _LOWER[raw]
        is_word = word[raw]
        prev = np.empty_like(is_word)
        nxt = np.empty_like(is_word)
        if len(raw):
            prev[0], prev[1:] = False, is_word[:-1]
            nxt[-1], nxt[:-1] = False, is_word[1:]
            inner = bounds[1:-1]
            inner = inner[inner < len(raw)]
            prev[inner] = False
            nxt[inner[inner > 0] - 1] = False
        starts = np.flatnonzero(is_word & ~prev)
        ends = np.flatnonzero(is_word & ~nxt) + 1
        yield Slice(i, j - i, raw, bounds, starts, ends, np.searchsorted(starts, bounds))
        i = j
