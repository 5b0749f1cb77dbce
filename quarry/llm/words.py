"""Vectorised word tables over Arrow string columns.

A column is handled as one byte buffer: separators, word bounds and 64-bit
word hashes come from a handful of numpy passes, with no Python string per
word.  Texts are UTF-8, so byte classes that only name ASCII separators cut
words exactly where the code-point classes would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_R = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}

SPACES = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_SPACE_SEP = np.isin(_SAME, np.frombuffer(SPACES, np.uint8))
_LETTER_SEP = ~((_LOWER >= 97) & (_LOWER <= 122) | (_LOWER >= 48) & (_LOWER <= 57) | (_LOWER >= 128))

#: (byte map, separator mask): words between ASCII white space, unchanged or
#: with A-Z lower-cased, and words of letters, digits and non-ASCII.
SPACED = (_SAME, _SPACE_SEP)
SPACED_LOWER = (_LOWER, _SPACE_SEP)
LETTERS_LOWER = (_LOWER, _LETTER_SEP)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    t = _POW.get(base)
    if t is None or len(t) < n:
        t = np.ones(1, U64) if t is None else t
        while len(t) < n:
            t = np.concatenate([t, t * U64(pow(base, len(t), 1 << 64))])
        _POW[base] = t
    return t[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); another salt gives another hash."""
    h = h + U64((salt * _R + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ngrams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of h[i:i+k] for every i with k values left (document bounds are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = (_R + 2 * salt) & (2**64 - 1)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _powers(base, len(h)), out=c[1:])
    return mix((c[k:] - c[:-k]) * _powers(pow(base, -1, 1 << 64), n), salt + k)


@dataclass
class Words:
    """Word table of some texts: bytes as mapped, bounds, hashes, first word of each text."""

    data: np.ndarray      # mapped bytes of all texts
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    hash: np.ndarray      # uint64 of each word
    first: np.ndarray     # first[i]:first[i+1] are the words of text i

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))

    def get(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])]


def word_table(texts: pa.Array, kind=SPACED) -> Words:
    """Words of every text of an Arrow string array (null: no words)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    lut, sep = kind
    data = lut[raw]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(sep[raw], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]                       # a word never crosses a text bound
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[1:-1][cut]
    stops[cut - 1] |= inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    c = np.zeros(len(data) + 1, U64)
    v = data.astype(U64)
    v += U64(1)
    v *= _powers(_R, len(data))
    np.cumsum(v, out=c[1:])
    h = (c[end] - c[start]) * _powers(_R_INV, len(data) + 1)[start]
    h = mix(h, 1) + (end - start).astype(U64) * U64(_R_INV)
    return Words(data, start, end, mix(h, 2), np.searchsorted(start, offsets))


def pieces(texts: pa.Array, limit: int = 1 << 20):
    """(from, to) row ranges of about ``limit`` bytes of text; a longer text is one piece."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    a, n = 0, len(size)
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
