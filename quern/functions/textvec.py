"""Vectorised words, word hashes and shingle sets over Arrow batches of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; this
is byte-wise, so no text is ever decoded. All loops run over lengths (chunks of eight bytes)
or over documents, never over words. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers with good avalanche."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column: text i is bytes[offsets[i]:offsets[i+1]]."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def loads8(data: np.ndarray) -> np.ndarray:
    """A view v with v[i] = the eight bytes from i on, little-endian; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def spans_of_words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of its first word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = solid[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes a round."""
    view, length = loads8(data), ends - starts
    out = mix((view[starts] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * _STEP)
    todo, k = np.flatnonzero(length > 8), 8
    while len(todo):
        part = view[starts[todo] + k] & _KEEP[np.minimum(length[todo] - k, 8)]
        out[todo] = mix(out[todo] * _STEP + part)
        k += 8
        todo = todo[length[todo] > k]
    return out


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each document the number of its first word."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = spans_of_words(data, offsets)
    return hash_spans(data, starts, ends), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, by the number of its first word."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    acc = words[:n].copy()
    for k in range(1, size):
        acc ^= acc >> U(29)
        acc *= _STEP
        acc += words[k : k + n]
    return mix(acc)


def shingle_sets(column, size: int = 5, short: bool = True) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of `size` words.

    With fewer words, the whole sequence is one shingle, or none without `short`; without words the set is empty.
    """
    words, first = word_hashes(column)
    shingles, out = shingle_hashes(words, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(shingles[a : b - size + 1])
            if len(x) > 1:
                fresh = np.empty(len(x), bool)
                fresh[0] = True
                np.not_equal(x[1:], x[:-1], out=fresh[1:])
                x = x[fresh]
            out.append(x)
        elif b > a and short:
            out.append(shingle_hashes(words[a:b], b - a) + U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def common_values(x: np.ndarray, least: int) -> np.ndarray:
    """The values that occur `least` times or more, sorted."""
    x = np.sort(x)
    found = x[: max(0, len(x) - least + 1)][x[least - 1 :] == x[: max(0, len(x) - least + 1)]] if len(x) >= least else x[:0]
    return np.unique(found)


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of x is one of the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x
