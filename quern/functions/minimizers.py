"""Minimizers: from every stretch of a text that is `window` bytes long, the least hash of its runs of `size` bytes.

Two texts that share a stretch of `window` bytes share its minimizer, so a text of that length or more is found in
others by any one of its own. A text has about 2 / (window - size + 2) of them a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import pieces
from quern.functions.textvec import loads8, mix, text_bytes

_STEP = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes from each byte on, as far as there are so many."""
    n = max(0, len(data) - size + 1)
    view, out = loads8(data), np.full(n, np.uint64(size))
    for k in range(0, size, 8):
        wide = min(8, size - k)
        part = view[k : k + n]
        if wide < 8:
            part = part & np.uint64((1 << (8 * wide)) - 1)
        out = mix(out * _STEP + part)
    return out


def least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    done = 1
    while done < width and len(x):
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


def minimizer_sets(column, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, minimizer), each once, in the order of texts."""
    data, offsets = text_bytes(column)
    least = least_of_windows(run_hashes(data, size), window - size + 1)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = text[: len(least)] == text[window - 1 :]  # windows that lie in one text
    keep[1:] &= ~((least[1:] == least[:-1]) & keep[:-1] & (text[1 : len(least)] == text[: len(least) - 1]))
    text, least = text[: len(least)][keep], least[keep]
    order = np.lexsort((least, text))
    text, least = text[order], least[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    return text[fresh], least[fresh]


def minimized(rows: DataFrame, id: str, text: str, window: int, size: int = 16) -> DataFrame:
    """(id, key): the distinct minimizers of each text; texts under `window` bytes, and null ones, have none."""
    size = min(size, max(1, window // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                owner, keys = minimizer_sets(part.column("text"), window, size)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(keys.view(np.int64))], names=["id", "key"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, key long").withColumnRenamed("id", id)
