"""Two-stage suffix sorting of one block of bytes, and the repeats that it shows."""

from __future__ import annotations

import numpy as np

from quern.functions.textvec import loads8


def _smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the end counts as smaller than all."""
    n = len(data)
    if n == 0:
        return np.zeros(0, bool)
    ends = np.r_[np.flatnonzero(data[1:] != data[:-1]), n - 1]
    rising = np.zeros(len(ends), bool)
    rising[:-1] = data[ends[:-1]] < data[ends[:-1] + 1]
    return np.repeat(rising, np.diff(np.r_[-1, ends]))


def _direct(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at`, sorted by their first `depth` bytes, eight bytes a round, ties only."""
    view, n = loads8(data), len(data)
    key = view[at].byteswap()
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    done = 8
    where = np.arange(len(at))
    while done < depth:
        alike = group[1:] == group[:-1]
        tied = np.zeros(len(group), bool)
        tied[1:] = alike
        tied[:-1] |= alike
        if not tied.any():
            break
        where, group = where[tied], group[tied]
        own = at[where]
        key = view[np.minimum(own + done, n)].byteswap()
        order = np.lexsort((key, group))
        at[where] = own[order]
        key, group = key[order], group[order]
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        done += 8
    return at


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of `data` in the order of their first `depth` bytes at least.

    Suffixes smaller than their successors are sorted directly. The others are induced: buckets by
    first byte are scanned in order, and each suffix found puts the one before it, if that is
    larger, at the end of the larger ones of its bucket; a bucket's own runs go in waves.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # From the end on, as of suffixes that tie with zeros beyond the end the shorter is the smaller.
    direct = _direct(data, np.flatnonzero(_smaller_than_next(data))[::-1], depth)
    heads = np.searchsorted(data[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        queues[c] = []
        bucket = []
        while len(wave):
            bucket.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[data[wave] == c]
        bucket.append(direct[heads[c] : heads[c + 1]])
        found = np.concatenate(bucket)
        if not len(found):
            continue
        out.append(found)
        before = found[found > 0] - 1
        first = data[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)], strict=True):
                queues[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether data[left:left+length] equals data[right:right+length], for each pair."""
    view = loads8(data)
    todo = np.arange(len(left))
    for k in range(0, length - 7, 8):
        todo = todo[view[left[todo] + k] == view[right[todo] + k]]
    if length % 8 and length >= 8:
        todo = todo[view[left[todo] + length - 8] == view[right[todo] + length - 8]]
    for k in range(length if length < 8 else 0):
        todo = todo[data[left[todo] + k] == data[right[todo] + k]]
    same = np.zeros(len(left), bool)
    same[todo] = True
    return same


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the marked `starts` (a boolean for each byte), those whose `length` bytes start at another too."""
    order = suffix_array(data, length)
    order = order[starts[order]]
    same = common_prefixes(data, order[:-1], order[1:], length)
    out = np.zeros(len(data), bool)
    out[order[:-1][same]] = True
    out[order[1:][same]] = True
    return out
