"""Phrase collocations by passes of growing length: PCY/DHP bucket counts, Apriori pruning, exact counts.

Texts are cut at sentence marks and line ends into pieces, pieces at blanks into words. Pass k counts phrases of k words
exactly, but only those that may be frequent: each of their two parts of k - 1 words must be (a bitmap of the hashes
of frequent ones, Apriori), and so must the phrase's bucket, which the pass before has counted (PCY). The pass also
counts the buckets of phrases of k + 1 words whose parts pass both filters (DHP). Filters only spare work:
what passes is counted by its words themselves, so counts are exact.

Bucket counters stop at `least`, which is all that the question whether a bucket reaches it needs; so they are one byte each,
sums of them are exact for that question, and a task sends `2^bits` bytes at most, in blocks whose sums meet block by block.
The driver gets and broadcasts bitmaps of `2^bits` bits (2 MB by default), whatever the data. Words, phrases and
counts stay in tables.

A task adds up its phrases before they leave it. A phrase's score comes from its lowest cut; each part's count is
joined by the part, one row a part, so a word that begins a third of all phrases makes a skewed join, which Spark splits, and
no more rows than phrases. A phrase goes if a longer candidate that contains it is
frequent enough beside it: longer ones send their count to each phrase inside, maxima are taken before the shuffle.
The first of each language are taken from `SALTS` parts first. Arithmetic is in decimals of 38 digits, exact for
counts under 10^16.

Nulls and oddities: a null text is empty, a null language is `und`, whose own rows count with those of that name. Words are
compared by bytes after lower-casing A-Z only. Repeated rows count each time. A long text is cut to parts of about 2 MB at
piece ends, so a worker's memory is bounded unless a single piece is longer. Equal scores and counts go by bytes
of the phrase. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.batches import pieces
from quern.functions.shared import cut, cut_to, drop_path, new_path
from quern.functions.textvec import _LOWER, hash_spans, mix, shingle_hashes, spans_of_words, text_bytes

#: Buckets are 2^BITS; counters travel in blocks of 2^BLOCK.
BITS, BLOCK, SALTS = 24, 16, 16
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_STOP
_SOLID[[0x20, 0x09]] = False
_MOST_BYTES = 2 << 20
#: Different phrases that a task holds before it adds them up and lets them go.
_HELD = 1 << 20
#: Phrases that are written out in one go; each of their bytes takes some 24 for the time.
_AT_ONCE = 1 << 14
_EMITTED = "lang string, phrase string, f long, slot int, block binary"


class Words:
    """The words of a batch of texts: spans, hashes with the language mixed in, and which words follow their neighbour."""

    def __init__(self, text, lang):
        data, offsets = text_bytes(text)
        self.data = np.append(_LOWER[data], np.uint8(0x20))
        starts, ends, first = spans_of_words(self.data[:-1], offsets, _SOLID)
        self.starts, self.ends = starts, ends
        tongue, cuts = text_bytes(lang)
        of = mix(hash_spans(tongue, cuts[:-1], cuts[1:]))
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.hash = mix(hash_spans(self.data, starts, ends) + of[self.doc])
        stops = np.cumsum(_STOP[self.data], dtype=np.int32)  # a part has about 2 MB
        piece = stops[starts] if len(starts) else np.zeros(0, np.int64)
        self.joined = np.zeros(max(0, len(starts) - 1), bool)
        if len(starts):
            self.joined = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])

    def hashes(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on, whether or not they are one piece."""
        return shingle_hashes(self.hash, k) if k > 1 else self.hash

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        n = max(0, len(self.starts) - k + 1)
        fine = np.ones(n, bool)
        for i in range(k - 1):
            fine &= self.joined[i : i + n]
        return fine

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of `at` on, joined by blanks."""
        if len(at) > _AT_ONCE:
            return pa.concat_arrays([self.phrases(at[i : i + _AT_ONCE], k) for i in range(0, len(at), _AT_ONCE)])
        word = (at[:, None] + np.arange(k)[None, :]).ravel()
        size = self.ends[word] - self.starts[word] + 1
        to = np.cumsum(size)
        place = np.repeat(self.starts[word] - np.r_[0, to[:-1]], size) + np.arange(to[-1] if len(to) else 0)
        out = self.data[place]
        out[to - 1] = 0x20
        last = np.zeros(len(word), bool)
        last[k - 1 :: k] = True
        keep = np.ones(len(out), bool)
        keep[to[last] - 1] = False
        cuts = np.r_[0, to[last] - np.arange(1, len(at) + 1)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out[keep]))


def _within(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Counters:
    """Counters of buckets that stop at `least`."""

    def __init__(self, bits: int, least: int):
        self.least, self.held = least, np.zeros(1 << bits, np.uint8)

    def add(self, bucket: np.ndarray, by: np.ndarray | None = None) -> None:
        bucket, number = np.unique(bucket, return_counts=True) if by is None else (bucket, by)
        self.held[bucket] = np.minimum(self.held[bucket] + np.minimum(number, self.least), self.least)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        parts = self.held.reshape(-1, min(len(self.held), 1 << BLOCK))
        for slot in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "block": pa.array([parts[slot].tobytes()], pa.binary())})


def _emitted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the columns that it lacks, as nulls."""
    kinds = {"lang": pa.string(), "phrase": pa.string(), "f": pa.int64(), "slot": pa.int32(), "block": pa.binary()}
    return pa.RecordBatch.from_pydict({name: batch.column(name) if name in batch.schema.names else pa.nulls(len(batch), kind) for name, kind in kinds.items()})


class Tally:
    """Phrases of a task with their counts, added up by hash; phrases whose second hashes differ stay apart."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(5)]
        self.rows = 0

    def add(self, own: np.ndarray, check: np.ndarray, number: np.ndarray, lang: pa.Array, phrase: pa.Array) -> Iterator[pa.RecordBatch]:
        for held, column in zip(self.columns, (own, check, number.astype(np.int32), lang, phrase), strict=True):
            held.append(column)
        self.rows += len(own)
        if self.rows > _HELD:
            yield from self.flush()

    def _whole(self, i: int, join=np.concatenate):
        """A column in one piece; its parts go."""
        out = join(self.columns[i])
        self.columns[i] = []
        return out

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.rows = 0
        # One column at a time is there twice.
        own = self._whole(0)
        order = np.argsort(own, kind="stable")
        own = own[order]
        fresh = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        del own
        check = self._whole(1)[order]
        fresh[1:] |= check[1:] != check[:-1]
        del check
        first = np.flatnonzero(fresh)
        sums = np.add.reduceat(self._whole(2)[order], first, dtype=np.int64)
        first = order[first]
        del order, fresh
        lang, phrase = self._whole(3, pa.concat_arrays), self._whole(4, pa.concat_arrays)
        for at in range(0, len(first), 1 << 17):
            some = pa.array(first[at : at + (1 << 17)])
            yield _emitted(pa.RecordBatch.from_pydict({"lang": lang.take(some), "phrase": phrase.take(some), "f": pa.array(sums[at : at + (1 << 17)])}))


def _cut_long(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A text of its own in parts of about `_MOST_BYTES` that end where a piece ends; other batches as they are."""
    data, _ = text_bytes(batch.column("text"))
    if len(batch) > 1 or len(data) <= _MOST_BYTES:
        yield batch
        return
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > _MOST_BYTES:
            look, to = at + _MOST_BYTES, 0
            while not to and look < len(data):
                stops = np.flatnonzero(_STOP[data[look : look + 65536]])
                to = look + int(stops[0]) + 1 if len(stops) else 0
                look += 65536
            to = to or len(data)
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "text": pa.array([data[at:to].tobytes()], pa.binary()).cast(pa.string())})
        at = to


def _pass(k: int, last: bool, bits: int, least: int, parts_bitmap, bucket_bitmap):
    """Counts of the phrases of k words that may be frequent; buckets of those of k + 1 words, unless `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if parts_bitmap is None else np.frombuffer(parts_bitmap.value, np.uint8)
        hashed = None if bucket_bitmap is None else np.frombuffer(bucket_bitmap.value, np.uint8)
        counters, tally = None if last else Counters(bits, least), Tally()
        for batch in batches:
            for part in (p for x in pieces(batch, "text", _MOST_BYTES) for p in _cut_long(x)):
                words = Words(part.column("text"), part.column("lang"))
                fine, own = words.whole(k), words.hashes(k)
                if k == 1:
                    docs = np.flatnonzero(np.bincount(words.doc, minlength=len(part)))
                    yield _emitted(pa.RecordBatch.from_pydict({"lang": part.column("lang").take(pa.array(docs)), "f": pa.array(np.bincount(words.doc, minlength=len(part))[docs])}))
                else:
                    shorter = _within(known, _bucket(words.hashes(k - 1), bits))
                    fine &= shorter[: len(fine)] & shorter[1 : len(fine) + 1] & _within(hashed, _bucket(own, bits))
                if not last:
                    longer = words.whole(k + 1)
                    longer &= fine[: len(longer)] & fine[1 : len(longer) + 1]
                    counters.add(_bucket(words.hashes(k + 1)[longer], bits))
                at = np.flatnonzero(fine)
                if not len(at):
                    continue
                order = np.argsort(own[at], kind="stable")
                at = at[order]
                fresh = np.ones(len(at), bool)
                # Equal hashes count as one phrase only where a second hash of the same words agrees.
                check = mix(own[at] + sum(np.uint64(3 + 2 * i) * words.hash[at + i] for i in range(k)))
                np.logical_or(own[at][1:] != own[at][:-1], check[1:] != check[:-1], out=fresh[1:])
                first = np.flatnonzero(fresh)
                number = np.diff(np.r_[first, len(at)])
                yield from tally.add(own[at[first]], check[first], number, part.column("lang").take(pa.array(words.doc[at[first]])), words.phrases(at[first], k))
        yield from tally.flush()
        if counters:
            yield from map(_emitted, counters.blocks())
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with no more than it needs

    return run


def _marked(k: int, bits: int):
    """Blocks with a mark for each bucket of the given phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(bits, 1)
        for batch in batches:
            words = Words(batch.column("phrase"), batch.column("lang"))
            first = np.searchsorted(words.doc, np.arange(len(batch)))
            bucket = _bucket(words.hashes(k)[first], bits)
            counters.add(bucket)
        yield from counters.blocks()

    return run


def _summed(least: int):
    """Sums of the blocks of each slot, from rows sorted by it, as bitmaps of the counters that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "block": pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for now, block in zip(batch.column("slot").to_pylist(), batch.column("block").to_pylist(), strict=True):
                block = np.frombuffer(block, np.uint8)
                if now != slot:
                    if slot is not None:
                        yield packed()
                    slot, held = now, block.copy()
                else:
                    held = np.minimum(held + block, least).astype(np.uint8)
        if slot is not None:
            yield packed()

    return run


def _bitmap(blocks: DataFrame, bits: int, least: int):
    """A broadcast bitmap of the buckets whose counters reach `least`."""
    wide = max(1, min(1 << bits, 1 << BLOCK) // 8)
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    sums = blocks.select("slot", "block").repartition("slot").sortWithinPartitions("slot").mapInArrow(_summed(least), "slot int, block binary")
    for row in sums.toLocalIterator():
        out[row["slot"] * wide : (row["slot"] + 1) * wide] = np.frombuffer(row["block"], np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(out.tobytes())


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = BITS, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of the phrases of 1, 2, ... words with f >= least], (lang, n) with all words of each language)."""
    if not 1 <= least <= 127:
        raise ValueError("counters of one byte need 1 <= least <= 127")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, known, hashed, totals = [], None, None, None
    for k in range(1, longest + 1):
        last = k == longest
        path = new_path(docs.sparkSession, f"phrases-{k}")
        raw = cut_to(rows.mapInArrow(_pass(k, last, bits, least, known, hashed), _EMITTED), path)
        if k == 1:
            totals = cut(raw.where("slot is null and phrase is null").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        counts = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        counts = cut(counts, f"counts-{k}")
        found.append(counts)
        if not last:
            known = _bitmap(counts.select("lang", "phrase").mapInArrow(_marked(k, bits), "slot int, block binary"), bits, 1)
            hashed = _bitmap(raw.where("slot is not null"), bits, least)
        drop_path(docs.sparkSession, path)
    return found, totals


def _counted(phrases: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    """`phrases` with the count of a part of each, which has one."""
    return phrases.withColumn("part", part).join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(name)), ["lang", "part"]).drop("part")


def _scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of two words or more, by their lowest cut."""
    out = None
    for k in range(2, len(counts) + 1):
        rows, w, cuts = counts[k - 1].select("lang", "phrase", F.col("f").alias("a")), F.split("phrase", " "), []
        for i in range(1, k):
            rows = _counted(rows, counts[i - 1], F.array_join(F.slice(w, 1, i), " "), f"l{i}")
            rows = _counted(rows, counts[k - i - 1], F.array_join(F.slice(w, i + 1, k - i), " "), f"r{i}")
            score = F.expr(f"(1000000BD * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l{i} as decimal(16,0)) * cast(r{i} as decimal(16,0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(i).alias("i"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")))
        lowest = rows.select("lang", "phrase", F.lit(k).alias("k"), "a", F.array_min(F.array(*cuts)).alias("cut"))
        scored = lowest.select("lang", "phrase", "k", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _covered(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, above): the largest count of a longer candidate that contains the phrase."""
    out = None
    for k in range(3, len(counts) + 1):
        for size in range(2, k):
            inside = F.array(*[F.array_join(F.slice("w", i, size), " ") for i in range(1, k - size + 2)])
            rows = counts[k - 1].select("lang", "f", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(inside).alias("phrase"))
            out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.groupBy("lang", "phrase").agg(F.max("f").alias("above"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, most: int = 2000, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first `most` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer candidate that contains it has `covered` per cent of its count or more.
    """
    counts, totals = phrase_counts(docs, longest, least, bits, text, lang)
    rows, above = _scored(counts), _covered(counts)
    if above is not None:
        rows = rows.join(above, ["lang", "phrase"], "left").where(f"above is null or 100 * above < {covered} * a").drop("above")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most).drop("salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
