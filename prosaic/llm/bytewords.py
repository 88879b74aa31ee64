"""Words, word hashes and shingles of whole Arrow batches, without a Python string per word.

A word is a maximal run of ASCII letters (lower-cased), ASCII digits and
non-ASCII characters: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became
a-z. In UTF-8 that is a property of single bytes, so texts are cut as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at a time; temporary arrays take about eight times as much.
SLICE = 2 << 20

_codes = np.arange(256)
WORD_BYTE = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)


_BYTE_VALUE = seeds(256, 17)[LOWER]


def _powers(n: int) -> np.ndarray:
    base = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=U64)
    base[0] = 1
    return np.cumprod(base, dtype=U64)


_POWER = _powers(1024)


def powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = _powers(max(n, 2 * len(_POWER)))
    return _POWER


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(at: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin."""
    n = len(body)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    inside = WORD_BYTE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < n]
    first[edge] = inside[edge]
    packed = np.flatnonzero(inside)
    if not len(packed):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    begin = np.flatnonzero(first[packed])
    lengths = np.diff(np.append(begin, len(packed)))
    place = np.arange(len(packed)) - np.repeat(begin, lengths)
    values = _BYTE_VALUE[body[packed]] * powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, begin) + lengths.astype(U64))
    return hashes, np.searchsorted(packed[begin], at).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (with repeats), and for each text where they begin.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    count = np.diff(at)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(begin[-1]), U64)
    factor = seeds(k, 29)
    doc = np.repeat(np.arange(len(count)), runs)
    start = at[:-1][doc] + np.arange(len(out)) - begin[:-1][doc]
    width = np.minimum(count, k)[doc]
    for i in range(k):
        live = slice(None) if i == 0 or (count >= k).all() else np.flatnonzero(width > i)
        out[live] += hashes[start[live] + i] * factor[i]
    return mix(out + width.astype(U64)), begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each text's values sorted and without repeats."""
    kept, sizes = [], np.zeros(len(begin), np.int64)
    for i in range(len(begin) - 1):
        part = np.sort(values[begin[i] : begin[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        kept.append(part)
        sizes[i + 1] = len(part)
    return (np.concatenate(kept) if kept else np.zeros(0, U64)), np.cumsum(sizes)
