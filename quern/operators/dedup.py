"""Near-duplicate rejection by exact Jaccard similarity, in the order in which rows come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import pieces
from quern.functions.shared import cut, sized
from quern.functions.text import shingled
from quern.functions.textvec import among


def shingle_classes(rows: DataFrame, id: str, text: str, size: int = 5) -> DataFrame:
    """(id, class_id, n_grams, grams): rows with equal shingle sets share the least id; empty sets stay alone.

    Sets are written once and compared by 128 bits of hashes; only classes of several rows are joined back, so sets travel
    only where there are too many of those to broadcast.
    """
    own = cut(shingled(rows, id, text, size).withColumnRenamed(id, "id__"), "sets")
    own = own.withColumn("name", F.when(F.size("grams") > 0, F.struct(F.xxhash64("grams").alias("a"), F.xxhash64("grams", F.lit(1)).alias("b"))))
    first = own.where("name is not null").groupBy("name").agg(F.min("id__").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = sized(cut(first, "equal-sets"))
    return own.join(first, "name", "left").select(F.col("id__").alias(id), F.coalesce("class_id", "id__").alias("class_id"), F.size("grams").alias("n_grams"), "grams")


#: Grams taken for common, at most; they only order the sets, so a wrong guess costs work and no pair.
COMMON = 1 << 16
#: Buckets of a set's profile.
PROFILE = 256
#: Grams that a worker looks at in one go.
_AT_ONCE = 1 << 17


def _common_grams(heads: DataFrame) -> np.ndarray:
    """Grams that occur often in a 64th of the sets, sorted, the most frequent `COMMON` of them."""
    some = heads.where(F.pmod(F.xxhash64("id__", "n"), F.lit(64)) == 0).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df >= 8")
    return np.sort(some.orderBy(F.desc("df"), "gram").limit(COMMON).select("gram").toArrow().column("gram").to_numpy().view(np.uint64))


def _rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts) of a list column of hashes; each list is sorted as unsigned numbers."""
    array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return array.values.to_numpy().view(np.uint64), array.offsets.to_numpy()


def _prefixes(common: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "grams", _AT_ONCE)):
            values, cuts = _rows(batch.column("grams"))
            taken, out = [], []
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                own = values[a:b]
                often = among(own, common)
                n = b - a
                first = np.concatenate([own[~often], own[often]])[: n - -(-n * percent // 100) + 1]
                out.append(first)
                taken.append(len(first))
            at = pa.array(np.repeat(np.arange(len(batch)), taken))
            yield pa.RecordBatch.from_arrays([batch.column("id__").take(at), batch.column("n").take(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))], names=["id__", "n", "gram"])

    return run


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole, "grams", _AT_ONCE)):
        values, cuts = _rows(batch.column("grams"))
        place = (values[cuts[0] : cuts[-1]] >> np.uint64(56)).astype(np.int64)
        owner = np.repeat(np.arange(len(batch)), np.diff(cuts))
        counts = np.bincount(owner * PROFILE + place, minlength=len(batch) * PROFILE).reshape(-1, PROFILE)
        counts = np.minimum(counts, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("id__"), pa.array([c.tobytes() for c in counts], pa.binary())], names=["id__", "profile"])


def _may_reach(percent: int):
    """Pairs whose profiles allow the threshold: sets share no more grams than the lesser counts of each bucket.

    A count of 255 may be any larger one; such pairs stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("one", "two"))
            most = np.minimum(one, two).sum(1, dtype=np.int64)
            sizes = one.sum(1, dtype=np.int64) + two.sum(1, dtype=np.int64)
            keep = pa.array((100 * most >= percent * (sizes - most)) | (one.max(1, initial=0) == 255) | (two.max(1, initial=0) == 255))
            yield batch.select(["left_id", "right_id"]).filter(keep)

    return run


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, lcuts = _rows(batch.column("one"))
            right, rcuts = _rows(batch.column("two"))
            common, n, m = np.zeros(len(batch), np.int64), np.diff(lcuts), np.diff(rcuts)
            for i in range(len(batch)):
                common[i] = among(left[lcuts[i] : lcuts[i + 1]], right[rcuts[i] : rcuts[i + 1]]).sum()
            keep = pa.array(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column("left_id"), batch.column("right_id"), pa.array(common), pa.array(common / np.maximum(n + m - common, 1))], names=["left_id", "right_id", "common", "jaccard"]).filter(keep)

    return run


def similar_pairs(classes: DataFrame, id: str, percent: int = 85) -> DataFrame:
    """(left_id, right_id, common, jaccard) of class representatives at or over the threshold, left < right.

    Two sets with Jaccard t share one of the first n - ceil(t n) + 1 grams of each in any common order; here that of hashes,
    common grams last, so a set sends a seventh of its grams at 85 %. Pairs that meet are compared by profiles first, the
    numbers of their grams in 256 ranges of hashes, which bound the overlap from above; whole sets are only sent for
    pairs that may reach the threshold.
    """
    kind = classes.schema[id].dataType.simpleString()
    heads = classes.where((F.col(id) == F.col("class_id")) & (F.col("n_grams") > 0)).select(F.col(id).alias("id__"), F.col("n_grams").cast("int").alias("n"), "grams")
    prefix = heads.mapInArrow(_prefixes(_common_grams(heads), percent), f"id__ {kind}, n int, gram long")
    right = prefix.toDF("right_id", "m", "gram")
    met = prefix.toDF("left_id", "n", "gram").join(right, "gram").where("left_id < right_id").where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("left_id", "right_id").distinct()
    met = cut(met, "met")
    profiles = cut(heads.select("id__", "grams").join(_ends(met), "id__", "left_semi").mapInArrow(_profiles, f"id__ {kind}, profile binary"), "profiles")
    both = met.join(profiles.toDF("right_id", "two"), "right_id").join(profiles.toDF("left_id", "one"), "left_id")
    near = cut(both.mapInArrow(_may_reach(percent), f"left_id {kind}, right_id {kind}"), "may-reach")
    some = cut(heads.select("id__", "grams").join(_ends(near), "id__", "left_semi"), "sets-of-pairs")
    sets = near.join(some.toDF("right_id", "two"), "right_id").join(some.toDF("left_id", "one"), "left_id")
    return sets.mapInArrow(_overlaps(percent), f"left_id {kind}, right_id {kind}, common long, jaccard double")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs."""
    return sized(cut(pairs.select(F.col("left_id").alias("id__")).unionByName(pairs.select(F.col("right_id").alias("id__"))).distinct(), "ends"))


def greedy_keep(rows: DataFrame, id: str, text: str, percent: int = 85, size: int = 5, most_rounds: int = 1000) -> DataFrame:
    """(id, kept): each row in order of id is kept unless a kept earlier one is near it.

    The same as one pass over the rows, in parallel rounds: a row is settled once all nearer earlier ones are; it is
    dropped beside a kept one, kept if all are dropped. Rounds are as many as the longest chain of neighbours.
    Rows without shingles are always kept; rows with equal sets are settled by their first.
    """
    classes = cut(shingle_classes(rows, id, text, size), "classes")
    edges = cut(similar_pairs(classes, id, percent).select("left_id", "right_id"), "pairs")
    spark = rows.sparkSession
    kind = edges.schema["left_id"].dataType.simpleString()
    dropped = spark.createDataFrame([], f"node {kind}")
    open_ = edges
    for _ in range(most_rounds):
        # Earlier ends that no open edge enters are kept; whoever is next to them is dropped.
        heads = open_.select(F.col("left_id").alias("node")).distinct().join(open_.select(F.col("right_id").alias("node")).distinct(), "node", "left_anti")
        lost = cut(open_.join(heads.withColumnRenamed("node", "left_id"), "left_id").select(F.col("right_id").alias("node")).distinct(), "dropped")
        if lost.isEmpty():
            break
        dropped = cut(dropped.unionByName(lost), "dropped")
        open_ = cut(open_.join(lost.withColumnRenamed("node", "left_id"), "left_id", "left_anti").join(lost.withColumnRenamed("node", "right_id"), "right_id", "left_anti").join(heads.withColumnRenamed("node", "left_id"), "left_id", "left_anti"), "open")
    else:
        raise RuntimeError("greedy selection did not settle")
    out = classes.select(id, "class_id", "n_grams").join(dropped.select(F.col("node").alias("class_id"), F.lit(True).alias("lost")), "class_id", "left")
    return out.select(id, ((F.col("n_grams") == 0) | (F.col("lost").isNull() & (F.col(id) == F.col("class_id")))).alias("kept"))


