"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(s - threshold_k) with thresholds in order and one score s for all grades: the
sum of shared weights of the text's hashed features, each times 1 + log(count). Features are the
words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased), their first four and first six
bytes, so that unseen forms of a known stem count, the runs between words, and whether a word repeats the one before. Of the 2^18 hash buckets, those keep a weight
whose presence depends on the grade: `least_texts` rated texts or more and chi-square over `least_chi`, which for
three grades one bucket in twenty models passes by chance.

The model is fitted on at most `most_ratings` ratings, those of the smallest hash of their id, so the
sample is bounded, the same on each run, and drawn from all. Features are counted and tested on the executors; the
sampled texts' selected features, six bytes each, meet in one task, which fits block by block, and the driver gets
weights and thresholds. Scoring is one pass over whole texts without a shuffle.

Nulls and oddities: a null text counts as empty; a text without selected features has score 0 and so
the sample's prior grades. Ratings with a null id or grade, or whose id has no text, teach nothing; several ratings of
one id all count. Grades that no rating has get their thresholds from smoothed counts. Without any
rating every text has the uniform grades. Repeated rows are scored each. A very long text is read whole, as a
batch of its own. Columns beside id and text are ignored but for those in `carry`, which must not bear the name of a
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.shared import cut
from quern.functions.batches import pieces
from quern.functions.textvec import _LOWER, hash_spans, mix, spans_of_words, text_bytes

BITS = 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STEMS = (4, 6)
_REPEAT = mix(np.array([1], np.uint64))[0]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the selected buckets, in the buckets' order, and the thresholds of grades 1, 2, ..."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(column, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's buckets, only those of the boolean table `chosen` if given."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = spans_of_words(data, offsets, _LETTER)
    words = hash_spans(data, starts, ends)
    stems = [mix(hash_spans(data, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in _STEMS]
    again = np.zeros(len(words), bool)
    np.equal(words[1:], words[:-1], out=again[1:])
    again[first[:-1][first[:-1] < len(words)]] = False
    starts, ends, first_gap = spans_of_words(data, offsets, ~_LETTER)
    gaps = mix(hash_spans(data, starts, ends))
    count = lambda cuts: np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
    text = np.concatenate([count(first)] * (1 + len(stems)) + [count(first_gap), count(first)[again]])
    bucket = (np.concatenate([words, *stems, gaps, np.full(int(again.sum()), _REPEAT)]) >> np.uint64(64 - BITS)).astype(np.int64)
    if chosen is not None:
        keep = chosen[bucket]
        text, bucket = text[keep], bucket[keep]
    key, number = np.unique((text << BITS) | bucket, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), number


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            text, bucket, number = features(part.column("text"))
            cuts = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"grade": part.column("grade"), "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()), "counts": pa.array([number[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary())})


def _presence(grades: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((grades, 1 << BITS), np.int64)
        for batch in batches:
            for grade, buckets in zip(batch.column("grade").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                found[grade, np.frombuffer(buckets, np.int32)] += 1
        g, b = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"grade": pa.array(g, pa.int64()), "bucket": pa.array(b, pa.int64()), "texts": pa.array(found[g, b], pa.int64())})

    return run


def _fit(grade: np.ndarray, cuts: np.ndarray, column: np.ndarray, count: np.ndarray, width: int, grades: int, l2: float, rounds: int, rate: float, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean log likelihood, thresholds kept in order.

    Text i has the features column[cuts[i]:cuts[i + 1]], as often as `count` says. Each round reads the texts in
    blocks of about `block` features.
    """
    prior = np.bincount(grade, minlength=grades) + 1.0
    above = 1 - np.cumsum(prior)[:-1] / prior.sum()
    x = np.r_[np.zeros(width), -np.log(above / (1 - above))]
    m, v, n = np.zeros_like(x), np.zeros_like(x), len(grade)
    value = (1 + np.log(np.arange(1, 1 << 16))).astype(np.float32)  # of each count
    parts, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + block, side="right")) - 1)
        parts.append((i, min(j, n)))
        i = min(j, n)
    for t in range(1, rounds + 1 if n else 1):
        g = np.zeros_like(x)
        for i, j in parts:
            own = column[cuts[i] : cuts[j]]
            worth = value[count[cuts[i] : cuts[j]] - 1]
            text = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(cuts[i : j + 1]))
            s = np.bincount(text, x[own] * worth, minlength=j - i)
            p = np.ones((j - i, grades + 1))
            p[:, -1] = 0
            p[:, 1:-1] = _sigmoid(s[:, None] - x[None, width:])
            slope, rows, grade_ = p * (1 - p), np.arange(j - i), grade[i:j]
            mass = np.maximum(p[rows, grade_] - p[rows, grade_ + 1], 1e-12)
            low, high = slope[rows, grade_] / mass, slope[rows, grade_ + 1] / mass
            g[:width] -= np.bincount(own, (low - high).astype(np.float32)[text] * worth, minlength=width)
            g[width:] += [low[grade_ == k].sum() - high[grade_ == k - 1].sum() for k in range(1, grades)]
        g /= n
        g[:width] += l2 * x[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x[width:] = np.maximum.accumulate(x[width:])
    return x[:width], x[width:]


def fit_ordinal(docs: DataFrame, ratings: DataFrame, grades: int, most_ratings: int = 20_000, least_texts: int = 3, least_chi: float = 31.0, l2: float = 3e-3, rounds: int = 150, rate: float = 0.05, id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on `ratings` (id, grade in 0 .. grades - 1) of the texts of `docs`.

    The penalty on squared weights is `l2`, or one over the number of ratings where those are fewer.
    """
    sample = ratings.select(F.col(id).alias("rated"), F.col("grade").cast("int").alias("grade")).where(f"rated is not null and grade between 0 and {grades - 1}")
    sample = sample.orderBy(F.xxhash64("rated"), "rated", "grade").limit(most_ratings)
    rated = docs.select(F.col(id).alias("rated"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "rated").select("grade", "text")
    hashed = cut(rated.mapInArrow(_hashed, "grade int, buckets binary, counts binary"), "rated")
    total = np.zeros(grades)
    for row in hashed.groupBy("grade").count().collect():
        total[row["grade"]] = row["count"]
    n = max(total.sum(), 1)
    seen = hashed.mapInArrow(_presence(grades), "grade long, bucket long, texts long").groupBy("bucket")
    seen = seen.agg(F.sum("texts").cast("double").alias("every"), *(F.sum(F.when(F.col("grade") == k, F.col("texts")).otherwise(0)).cast("double").alias(f"g{k}") for k in range(grades)))
    off = lambda got, expected: (got - expected) * (got - expected) / F.greatest(expected, F.lit(1e-9))
    every = F.col("every")
    chi = sum((off(F.col(f"g{k}"), every * float(t / n)) + off(float(t) - F.col(f"g{k}"), (float(n) - every) * float(t / n)) for k, t in enumerate(total)), F.lit(0.0))
    chosen = seen.where((every >= least_texts) & (chi > least_chi)).select("bucket").toArrow()
    buckets = np.sort(chosen.column("bucket").to_numpy())
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, c in zip(batch.column("buckets").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                b, c = place[np.frombuffer(b, np.int32)], np.frombuffer(c, np.int32)
                out.append((b[b >= 0].tobytes(), np.minimum(c[b >= 0], 65535).astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_pydict({"grade": batch.column("grade"), "buckets": pa.array([x for x, _ in out], pa.binary()), "counts": pa.array([x for _, x in out], pa.binary())})

    width, penalty = len(buckets), max(l2, 1 / n)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows come sorted, so that sums don't depend on the partitions' order; each batch goes once it is copied.
        grades_, sizes, columns, counts = [], [], bytearray(), bytearray()
        for batch in batches:
            grades_ += batch.column("grade").to_pylist()
            for b, c in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                columns += b.as_buffer()
                counts += c.as_buffer()
                sizes.append(len(c.as_buffer()) // 2)
        cuts = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        column, count, grade = np.frombuffer(columns, np.int32), np.frombuffer(counts, np.uint16), np.array(grades_, np.int64)
        weights, thresholds = _fit(grade, cuts, column, count, width, grades, penalty, rounds, rate)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "thresholds": pa.array([thresholds.tobytes()], pa.binary())})

    sampled = hashed.mapInArrow(select, "grade int, buckets binary, counts binary").repartition(1).sortWithinPartitions("grade", "buckets", "counts")
    model = sampled.mapInArrow(fit, "weights binary, thresholds binary").first()
    weights, thresholds = (np.frombuffer(model[k]) for k in ("weights", "thresholds")) if model else _fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16), width, grades, penalty, 0, rate)
    return OrdinalModel(buckets, weights, thresholds)


def _score(model: OrdinalModel, select: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        chosen[model.buckets], weight[model.buckets] = True, model.weights
        for batch in batches:
            for part in pieces(batch, "text"):
                text, bucket, number = features(part.column("text"), chosen)
                tails = model.tails(np.bincount(text, weight[bucket] * (1 + np.log(number)), minlength=len(part)))
                columns = {k: part.column(k) for k in part.schema.names}
                yield pa.RecordBatch.from_pydict(columns | {"expected_grade": pa.array(tails.sum(1)), "tail_probability": pa.array(tails[:, select - 1]), "kept": pa.array(tails[:, select - 1] >= least)})

    return run


def score_ordinal(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.5, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, expected_grade, tail_probability, kept, and the columns `carry`.

    tail_probability is P(grade >= select); `kept` says that it reaches `least`. `with_text` adds the text.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), *(F.col(k).alias(f"carry_{k}") for k in carry))
    schema = StructType([*rows.schema, *StructType.fromDDL("expected_grade double, tail_probability double, kept boolean")])
    scored = rows.mapInArrow(_score(model, select, least), schema)
    return scored.select(F.col("id").alias(id), *([F.col("text").alias(text)] if with_text else []), *(F.col(f"carry_{k}").alias(k) for k in carry), "expected_grade", "tail_probability", "kept")


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of `labels`: 0 for toxic, 1 for low quality, 2 for good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
