"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose `column` (strings or binary; of lists, so many values) holds about `most_bytes` at most.

    A value over that is a slice of its own; every row is in one slice.
    """
    array = batch.column(batch.schema.get_field_index(column))
    wide = np.dtype(np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32)
    if len(batch) == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(batch))
        yield batch.slice(at, to - at)
        at = to


def binary(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal `keys` (integers, without nulls), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        fresh = np.zeros(len(batch), bool)
        for x in columns:
            fresh[1:] |= x[1:] != x[:-1]
        first = tuple(x[0] for x in columns)
        fresh[0] = first != last
        cuts = np.flatnonzero(fresh).tolist()
        if held and (cuts[0] if cuts else len(batch)) > 0:
            held.append(batch.slice(0, cuts[0] if cuts else len(batch)))
        if cuts:
            if held:
                yield pa.Table.from_batches(held)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            held = [batch.slice(cuts[-1])]
        last = tuple(x[-1] for x in columns)
    if held:
        yield pa.Table.from_batches(held)
