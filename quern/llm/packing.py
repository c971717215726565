"""Packing tokenised examples by vector bin packing with the dot-product heuristic.

A sequence is a bin with three limits: tokens, segments and loss-bearing tokens. What of an example
fills sequences of its own is cut off first. Of the rest, the open bin takes the piece that fits and whose
demand has the largest dot product with the bin's remaining room, each measured in the limits; so a
bin short of one resource takes pieces that use little of it. When no piece fits whole and tokens
are left, the longest piece is cut so as to fill the bin.

Every task packs the rows that it reads, in one pass without a shuffle, holding at most `POOL`
pieces of under one sequence each, and ends with at most one bin left open; so padding is under one
sequence a task where loss and segments don't bind. A sequence's id has the task's number above
2^40.

Nulls and oddities: a null text has the ids of an empty one, that is only the end id. Repeated rows are
packed as often as they come. A null `loss_from` counts as 1. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import pieces
from quern.llm.tokens import document_ids

POOL = 768
_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_PIECES_SQL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids array<int>"


class Packer:
    """Bins of one task. `emit` gets (piece, sequence, offset); a piece: [id, ids, loss_from, start, end]."""

    def __init__(self, tokens: int, segments: int, loss: int, first: int, emit) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are 1 at least")
        self.limit, self.emit, self.next = np.array([tokens, segments, loss], np.float64), emit, first
        self.pool: list[list] = []
        self.need = np.zeros((0, 3))
        self.fresh: list[list] = []

    @staticmethod
    def loss(loss_from: int, start: int, end: int) -> int:
        return max(0, end - max(start, loss_from))

    def reach(self, loss_from: int, start: int, end: int, tokens: int, loss: int) -> int:
        """How far from `start` a piece can go within so many tokens and loss-bearing ones."""
        return min(end, start + tokens, max(start, loss_from) + loss)

    def add(self, id, ids: np.ndarray, loss_from: int) -> None:
        at, tokens, loss = 0, int(self.limit[0]), int(self.limit[2])
        while len(ids) - at >= tokens or self.loss(loss_from, at, len(ids)) > loss:
            to = self.reach(loss_from, at, len(ids), tokens, loss)
            if to - at < tokens:  # the loss limit cut it short: others without loss may join it
                self.fresh.append([id, ids, loss_from, at, to])
            else:
                self.emit((id, ids, loss_from, at, to), self.next, 0)
                self.next += 1
            at = to
        if at < len(ids):
            self.fresh.append([id, ids, loss_from, at, len(ids)])
        if len(self.pool) + len(self.fresh) > POOL:
            self.pack(POOL // 2)

    def pack(self, leave: int) -> None:
        """Fill bins until `leave` pieces are left at most; with 0, all."""
        pool = self.pool + self.fresh
        self.fresh = []
        need = np.array([[p[4] - p[3], 1, self.loss(*p[2:])] for p in pool], np.float64).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        left = len(pool)
        scaled = need / self.limit**2
        while left > leave:
            room, offset = self.limit.copy(), 0
            while left:
                fits = np.flatnonzero(alive & (need <= room).all(1))
                if len(fits):
                    k = int(fits[np.argmax(scaled[fits] @ room)])
                    id, ids, loss_from, a, b = pool[k]
                    to = b
                else:
                    if room[0] < 1 or room[1] < 1:
                        break
                    k = int(np.argmax(np.where(alive, need[:, 0], -1)))
                    id, ids, loss_from, a, b = pool[k]
                    to = self.reach(loss_from, a, b, int(room[0]), int(room[2]))
                    if to <= a:
                        break
                self.emit((id, ids, loss_from, a, to), self.next, offset)
                offset += to - a
                room -= [to - a, 1, self.loss(loss_from, a, to)]
                if to == b:
                    alive[k] = False
                    left -= 1
                else:
                    pool[k] = [id, ids, loss_from, to, b]
                    need[k] = [b - to, 1, self.loss(loss_from, to, b)]
                    scaled[k] = need[k] / self.limit**2
            self.next += 1
        self.pool = [p for p, x in zip(pool, alive, strict=True) if x]


def _pack(path: str, tokens: int, segments: int, loss: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows: list[tuple] = []

        def emit(piece, sequence: int, offset: int) -> None:
            id, ids, loss_from, a, b = piece
            own = ids[a:b]
            rows.append((id, a, b - a, zlib.crc32(own.astype("<u4").tobytes()), len(ids), sequence, offset, Packer.loss(loss_from, a, b), own.astype(np.int32) if with_ids else None))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
            rows.clear()
            return out

        packer = Packer(tokens, segments, loss, (task.partitionId() if task else 0) << 40, emit)
        for got in batches:
            for part in pieces(got, "text", 1 << 20):
                for id, ids, loss_from in zip(part.column("id").to_pylist(), document_ids(part.column("text").to_pylist(), path), part.column("loss_from").to_pylist(), strict=True):
                    packer.add(id, ids, 1 if loss_from is None else loss_from)
                if rows:
                    yield batch()
        packer.pack(0)
        if rows:
            yield batch()

    return run


def pack_documents(docs: DataFrame, path: str, tokens: int = 1024, segments: int = 128, loss: int = 1024, loss_from: str | None = None, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    `path` is the tokenizers file; a document's ids end with id 0. `loss_from` names a column with
    the place of the first loss-bearing id, 1 by default: nothing predicts a document's first id.
    Each id lies in exactly one piece; a sequence's pieces follow each other from offset 0.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), (F.col(loss_from) if loss_from else F.lit(1)).cast("long").alias("loss_from"))
    return rows.mapInArrow(_pack(path, tokens, segments, loss, with_ids), _PIECES_SQL).withColumnRenamed("id", id)
