"""Removal of repeated byte strings, by suffix sorting in blocks that meet by content.

Every byte covered by a string of `length` bytes that also starts anywhere else, in any text or
the same, is found; matches don't cross texts.

1. Each window of `length` bytes has an anchor: the leftmost of its least `GRAM`-byte hashes. As it
   depends on the window's bytes alone, equal windows have equal anchors at the same place. An
   anchor serves a run of windows, some 70 on average, so texts send about one anchor for 70
   bytes. Anchors that occur once anywhere have no repeated window.
2. Repeated anchors return to their texts, which send the context of each: the bytes of all the
   windows that it serves.
3. Contexts of one anchor meet. If all are the same, each of their windows is repeated. Otherwise
   the distinct ones, block by block, are suffix-sorted in two stages and adjacent common
   prefixes show the repeated windows. A name with more than a block is told apart first by what
   runs of 16, 4 and 1 of its windows share.
4. The repeated runs return to the texts, which lose those bytes.

Skew: equal contexts within a piece of input are merged before the shuffle and known to be
repeated there, so the inside of a passage that a third of the texts share sends one row a piece.
An anchor that `HOT` windows' runs of one piece share is known to be repeated there: its occurrences
return to their texts directly, and its place gets one mark. Marked anchors, and those with more than
`heavy` occurrences, cut their windows into runs of `FINE`, each under a name made from the bytes that
all the run's windows share, so that contexts which differ there part. What is left are runs at the edge of a
common passage, alike in the passage and different beside it: where a piece has `CROWD` of them under one name, or
more than `HELD` bytes meet, their windows go under names of their own, 16-byte digests that are counted in a
second shuffle.

Nulls and oddities: a null text counts as empty. Rows are told apart by a 64-bit hash of id and
text; rows alike in both are copies of one another and each loses what the other repeats. Texts
shorter than `length` lose nothing. A very long text is read whole, as a piece of its own: a worker's memory grows
with the longest text. Columns beside id and text are ignored but for those in `carry`, which must not bear the
name of a result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.functions.batches import pieces
from quern.functions.shared import cut
from quern.llm.suffix_sort import repeated
from quern.functions.textvec import among, common_values, loads8, mix, text_bytes

GRAM, FINE, PLACE_BITS = 64, 16, 28
#: Bytes of input treated at once, of contexts in one suffix array, and of the contexts of one name that a worker holds.
PIECE, BLOCK, HELD = 1 << 20, 1 << 19, 8 << 20
#: Windows in the runs by which one name's contexts are told apart, while they are too many for one suffix array.
FINER = (FINE, 4, 1)
#: Different contexts of a fine name in one piece that send its windows under their own names.
CROWD = 32
#: Occurrences of an anchor in one piece that make it known as repeated.
HOT = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_ANCHORS = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("row", pa.binary()), ("at", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("anchor", pa.binary())])
_ANCHORS_SQL = "place int, kind int, row binary, at binary, low binary, high binary, anchor binary"
ASKED, DIRECT, MARK = range(3)
_FOUND = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int64()), ("many", pa.bool_())])
_FOUND_SQL = "row long, at int, low int, high int, anchor long, many boolean"
_CONTEXT = pa.schema([("name", pa.int64()), ("kind", pa.int32()), ("row", pa.int64()), ("start", pa.int32()), ("lead", pa.int32()), ("body", pa.binary())])
_CONTEXT_SQL = "name long, kind int, row long, start int, lead int, body binary"
#: What a row of the second meeting is: a context, one known to be repeated, a repeated run, the names of single windows, those of known repeated ones, or a note that a name's windows go by their own names.
LONE, KNOWN, SPAN, WINDOWS, REPEATED, APART = range(6)
_MATCHED = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("spans", pa.binary()), ("windows", pa.binary())])
_MATCHED_SQL = "row long, start int, spans binary, windows binary"
#: Bytes of a window's own name.
DIGEST = 16


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place in it, first window, last window, hash) of the anchors of all windows."""
    width = length - gram + 1
    n = len(data) - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < width:
        return none
    view = loads8(data)
    hashes = np.zeros(n, np.uint64)
    for j in range(gram // 8):
        hashes += view[8 * j : 8 * j + n] * _ODD[j % 8]
        hashes ^= hashes >> np.uint64(31)
    if gram % 8:
        hashes += view[gram - 8 : gram - 8 + n] * _ODD[7] if gram > 8 else (view[:n] & np.uint64((1 << 8 * gram) - 1)) * _ODD[7]
    hashes = mix(hashes)
    least = (hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int32)
    ok = offsets[1:] - offsets[:-1] >= length
    np.add.at(inside, offsets[:-1][ok], 1)
    np.add.at(inside, np.minimum(offsets[1:][ok] - length + 1, len(place)), -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return none
    place = place[windows]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    own = np.searchsorted(offsets, windows[first], side="right") - 1
    return own, place[first] - offsets[own], windows[first] - offsets[own], windows[last] - offsets[own], hashes[place[first]]


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Where anchors meet: by their low bits, as the high ones of least hashes are mostly zeros."""
    return (h & np.uint64((1 << bits) - 1)).astype(np.uint16)


def _send_anchors(length: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                data, offsets = text_bytes(part.column("text"))
                own, at, i, j, h = anchors(data, offsets, length, gram)
                if not len(own):
                    continue
                row = part.column("row").to_numpy()[own]
                hot = common_values(h, HOT)
                rows = []
                if len(hot):
                    warm = among(h, hot)
                    to = int(np.bitwise_xor.reduce(row).item()) & ((1 << bits) - 1)  # any place: nothing is looked up
                    rows = [(to, DIRECT, *_packed(row[warm], at[warm], i[warm], j[warm], h[warm]))]
                    hot = hot[np.argsort(_places(hot, bits), kind="stable")]
                    rows += [(p, MARK, b"", b"", b"", b"", hot[a:b].tobytes()) for p, a, b in _by(_places(hot, bits))]
                    row, at, i, j, h = (x[~warm] for x in (row, at, i, j, h))
                place = _places(h, bits)
                order = np.argsort(place, kind="stable")
                row, at, i, j, h, place = (x[order] for x in (row, at, i, j, h, place))
                rows += [(p, ASKED, *_packed(row[a:b], at[a:b], i[a:b], j[a:b], h[a:b])) for p, a, b in _by(place)]
                yield _batch(_ANCHORS, rows)

    return run


def _packed(row: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray) -> tuple[bytes, ...]:
    return row.tobytes(), at.astype(np.int32).tobytes(), (at - i).astype(np.int16).tobytes(), (at - j).astype(np.int16).tobytes(), h.tobytes()


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _by(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted key: (key, from, to)."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    yield from zip(key[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True)


def _found(heavy: int):
    """In each part of the hash space: the anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        marks: dict[int, list] = {}

        def found(row, at, low, high, h, many) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(many)], schema=_FOUND)

        for batch in batches:
            for p, kind, row, at, low, high, h in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h, row, at, low, high = np.frombuffer(h, np.uint64), np.frombuffer(row, np.int64), np.frombuffer(at, np.int32), np.frombuffer(low, np.int16), np.frombuffer(high, np.int16)
                if kind == MARK:
                    marks.setdefault(p, []).append(h)
                elif kind == DIRECT:
                    yield found(row, at, low, high, h, np.ones(len(h), bool))
                else:
                    held.setdefault(p, []).append((h, row, at, low, high))
        for p in list(held):
            h, row, at, low, high = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            order = np.argsort(h)
            first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            count = np.empty(len(h), np.int64)
            count[order] = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
            marked = among(h, np.unique(np.concatenate(marks[p]))) if p in marks else np.zeros(len(h), bool)
            x = np.flatnonzero((count > 1) | marked)
            for a in range(0, len(x), 50_000):
                y = x[a : a + 50_000]
                yield found(row[y], at[y], low[y], high[y], h[y], (count[y] > heavy) | marked[y])

    return run


def _name(core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)


def _runs(lead: int, windows: int, fine: int) -> Iterator[tuple[int, int, int]]:
    """The first `windows` windows of a context whose anchor is at `lead`, in runs that a place's distance to its anchor fixes: (block, first, last)."""
    for block in range((lead - windows + 1) // fine, lead // fine + 1):
        yield block, max(0, lead - block * fine - fine + 1), min(windows - 1, lead - block * fine)


def _core(body: bytes, lead: int, block: int, fine: int, length: int) -> bytes:
    """What all windows of a run share; it lies in every context that has one of them."""
    return body[lead - block * fine : lead - block * fine - fine + 1 + length]


def _window_names(body: bytes, length: int) -> bytes:
    return b"".join(hashlib.blake2b(body[k : k + length], digest_size=DIGEST).digest() for k in range(len(body) - length + 1))


def _send_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                seen: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
                crowd: dict[int, int] = {}
                data, offsets = text_bytes(part.column("text"))
                whole = data.tobytes()
                for base, row, found in zip(offsets[:-1].tolist(), part.column("row").to_pylist(), part.column("found"), strict=True):
                    fields = [found.values.field(f).to_pylist() for f in ("at", "low", "high", "anchor", "many")]
                    for at, low, high, name, many in zip(*fields, strict=True):
                        i, j = at - low, at - high
                        body = whole[base + i : base + j + length]
                        if not many:
                            seen.setdefault((name, low, body), []).append((row, i))
                            continue
                        for block, a, b in _runs(low, j - i + 1, FINE):
                            fine = _name(name.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little", signed=True) + _core(body, low, block, FINE, length))
                            uses = seen.setdefault((fine, low - a, body[a : b + length]), [])
                            if not uses:
                                crowd[fine] = crowd.get(fine, 0) + 1
                            uses.append((row, i + a))
                out = []
                for (name, lead, body), where in seen.items():
                    if crowd.get(name, 0) < CROWD:
                        out.append((name, KNOWN if len(where) > 1 else LONE, *where[0], lead, body))
                        rest = where[1:]
                    else:  # those alike tell others once that their windows are repeated
                        row, start = where[0]
                        out.append((row, REPEATED if len(where) > 1 else WINDOWS, row, start, 0, _window_names(body, length)))
                        rest = where if len(where) > 1 else []
                    # Known to be repeated: they pass as spans, spread by row.
                    out += [(row, SPAN, row, start, 0, len(body).to_bytes(4, "little")) for row, start in rest]
                out += [(name, APART, 0, 0, 0, b"") for name, n in crowd.items() if n >= CROWD]
                for a in range(0, len(out), 4096):
                    yield _batch(_CONTEXT, out[a : a + 4096])

    return run


def _ones(flags: np.ndarray) -> np.ndarray:
    """(n, 2): from and to of the runs of true."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


class _Meeting:
    """Groups of contexts under one name, each {(lead, body): [(row, start, known)]}, to spans of repeated bytes."""

    def __init__(self, length: int, found) -> None:
        self.length, self.found = length, found
        self.waiting: list[tuple[bytes, int, int, bool]] = []
        self.size = 0

    def add(self, group: dict[tuple[int, bytes], list], level: int = 0) -> None:
        for (_, body), uses in group.items():
            if len(uses) > 1:
                for row, start, known in uses:
                    if not known or not level:
                        self.found(row, start, start + len(body))
            elif uses[0][2] and not level:
                self.found(uses[0][0], uses[0][1], uses[0][1] + len(body))
        if len(group) < 2:
            return
        size = sum(len(body) for _, body in group)
        if size > BLOCK and level < len(FINER):
            self.split(group, level)
            return
        if self.size + size > BLOCK:
            self.settle()
        self.size += size
        self.waiting += [(body, uses[0][0], uses[0][1], len(uses) == 1 and not uses[0][2]) for (_, body), uses in group.items()]

    def split(self, group: dict[tuple[int, bytes], list], level: int) -> None:
        """Too much to sort at once: the windows of each run of places meet by what they share."""
        fine, length = FINER[level], self.length
        blocks = [range((lead - len(body) + length) // fine, lead // fine + 1) for lead, body in group]
        for block in range(min(b.start for b in blocks), max(b.stop for b in blocks)):
            parts: dict[bytes, dict[tuple[int, bytes], list]] = {}
            for (lead, body), uses in group.items():
                a, b = max(0, lead - block * fine - fine + 1), min(len(body) - length, lead - block * fine)
                if a > b:
                    continue
                row, start, known = uses[0]
                part = parts.setdefault(_core(body, lead, block, fine, length), {})
                part.setdefault((lead - a, body[a : b + length]), []).append((row, start + a, known or len(uses) > 1))
            for part in parts.values():
                self.add(part, level + 1)

    def settle(self) -> None:
        """Suffix-sort what waits."""
        if not self.waiting:
            return
        data = np.frombuffer(b"\0".join(x[0] for x in self.waiting), np.uint8)
        size = np.array([len(x[0]) for x in self.waiting])
        base = np.r_[0, np.cumsum(size + 1)[:-1]]
        mark = np.zeros(len(data) + 1, np.int8)
        mark[base] += 1
        mark[base + size - self.length + 1] -= 1
        again = repeated(data, np.cumsum(mark[:-1]).astype(bool), self.length)
        lone = np.array([x[3] for x in self.waiting])
        for k in np.flatnonzero(lone & (np.add.reduceat(again, base) > 0)):
            _, row, start, _ = self.waiting[k]
            for a, b in _ones(again[base[k] : base[k] + size[k]]).tolist():
                self.found(row, start + a, start + b - 1 + self.length)
        self.waiting, self.size = [], 0


def _match(length: int):
    """Contexts, sorted by name and notes first, to spans of repeated bytes and names of windows that meet once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[int, list[int]] = {}
        windows: list[tuple] = []
        meeting = _Meeting(length, lambda row, a, b: spans.setdefault(row, []).extend((a, b)))
        at, group, held, apart = None, {}, 0, False

        def pack() -> pa.RecordBatch:
            rows = [(row, None, np.array(x, np.int32).tobytes(), None) for row, x in spans.items()] + windows
            spans.clear()
            windows.clear()
            return _batch(_MATCHED, rows)

        def let_go() -> None:
            for (_, body), uses in group.items():
                repeated_ = len(uses) > 1 or uses[0][2]
                windows.append((uses[0][0], None if repeated_ else uses[0][1], None, _window_names(body, length)))
                if repeated_:
                    for row, start, _ in uses:
                        meeting.found(row, start, start + len(body))
            group.clear()

        for batch in batches:
            for name, kind, row, start, lead, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == SPAN:
                    meeting.found(row, start, start + int.from_bytes(body, "little"))
                    continue
                if kind in (WINDOWS, REPEATED):
                    windows.append((row, start if kind == WINDOWS else None, None, body))
                    continue
                if name != at:
                    meeting.add(group)
                    at, group, held, apart = name, {}, 0, False
                if kind == APART:
                    apart = True
                    continue
                uses = group.setdefault((lead, body), [])
                held += 24 if uses else len(body) + 200
                uses.append((row, start, kind == KNOWN))
                if apart or held > HELD:
                    apart = True
                    let_go()
                if len(spans) > 4096 or len(windows) > 4096:
                    yield pack()
            if spans or windows:
                yield pack()
        meeting.add(group)
        meeting.settle()
        if spans or windows:
            yield pack()

    return run


_KEPT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"
_KEPT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def whole_characters(kept: bytes) -> str:
    """UTF-8 text of what is left: a character that lost some of its bytes goes."""
    return kept.decode("utf-8", "ignore")


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans (n, 2)."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return list(zip(spans[first, 0].tolist(), reach[np.r_[first[1:] - 1, len(spans) - 1]].tolist(), strict=True))


def _cut_out(with_text: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                data, offsets = text_bytes(part.column("text"))
                whole, rows = data.tobytes(), []
                for a, b, id, found, starts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *(part.column(k).to_pylist() for k in ("id", "spans", "starts")), strict=True):
                    text, starts = whole[a:b], np.array(starts or [], np.int32)
                    runs = merged(np.concatenate([*(np.frombuffer(x, np.int32) for x in found or []), np.stack([starts, starts + length], 1).ravel()]).reshape(-1, 2))
                    kept = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(text)], strict=True))
                    rows.append((id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None, [{"start": x, "end": y} for x, y in runs] if with_text else None))
                found = _batch(_KEPT, rows)
                extra = [k for k in part.schema.names if k.startswith("carry_")]
                texts = [pa.array([whole_characters(x[5]) for x in rows], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*found.columns, *texts, *(part.column(k) for k in extra)], names=[*found.schema.names, *["text"] * with_text, *extra])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id: str = "doc_id", text: str = "text", heavy: int = 16384, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, and more with `with_text`.

    With it come `kept`, the bytes left in order, `spans`, the maximal removed runs, and the text column:
    what is left without broken characters. `carry` names other columns to keep. See the module for nulls.
    """
    if length < 16:
        raise ValueError("length is 16 bytes at least")
    spark = docs.sparkSession
    gram, partitions = min(GRAM, length // 2 // 8 * 8), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = min(16, max(6, partitions.bit_length()))
    extra = [f"carry_{k}" for k in carry]
    texts = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(k).alias(f"carry_{k}") for k in carry))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    sent = texts.select("row", "text").mapInArrow(_send_anchors(length, gram, bits), _ANCHORS_SQL)
    found = sent.repartitionById(1 << bits, F.col("place")).mapInArrow(_found(heavy), _FOUND_SQL)
    found = found.groupBy("row").agg(F.collect_set(F.struct("at", "low", "high", "anchor", "many")).alias("found"))
    contexts = texts.select("row", "text").repartition(partitions, "row").join(found, "row").select("row", "text", "found").mapInArrow(_send_contexts(length), _CONTEXT_SQL)
    matched = cut(contexts.repartition(partitions, "name").sortWithinPartitions("name", F.desc("kind")).mapInArrow(_match(length), _MATCHED_SQL), "matched")
    single = matched.where("windows is not null").select("row", F.explode(F.expr(f"transform(sequence(0, length(windows) div {DIGEST} - 1), k -> struct(start + k AS start, substring(windows, k * {DIGEST} + 1, {DIGEST}) AS name))")).alias("w")).select("row", "w.*")
    twice = single.groupBy("name").agg(F.sum(F.when(F.col("start").isNull(), 2).otherwise(1)).alias("n")).where("n > 1").select("name")
    spans = matched.where("spans is not null").select("row", "spans", F.lit(None).cast("int").alias("start"))
    spans = spans.unionByName(single.where("start is not null").join(twice, "name").select("row", F.lit(None).cast("binary").alias("spans"), "start"))
    spans = spans.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("start").alias("starts"))
    kept = StructType([*StructType.fromDDL(_KEPT_SQL + ", text string" * with_text), *(StructField(k, texts.schema[k].dataType) for k in extra)])
    out = texts.repartition(partitions, "row").join(spans, "row", "left").select("id", "row", "text", "spans", "starts", *extra).mapInArrow(_cut_out(with_text, length), kept)
    # The input's column names may be those of results: each is named by its place.
    left = [k for k in out.columns if with_text or k not in ("kept", "spans")]
    new = {"id": id, "text": text} | {f"carry_{k}": k for k in carry}
    return out.select(*(F.col(k).alias(new.get(k, k)) for k in left))
