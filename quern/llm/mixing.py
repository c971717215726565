"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variable divided by its quality weight, -ln(u) / w with u from
a hash of its id and text; sources are sorted by key, so that the first documents are a weighted sample
without replacement. A source whose target exceeds its size is first taken whole as often as fits
(complete epochs); the rest of its target goes to the documents whose prefix sums fall under it, where the
one that crosses is taken if that comes nearer.

Targets: a budget of `share` times all sizes is dealt by weight; a source stops at `most` times its
size, and the excess is dealt again by weight until none is above. That has a closed form: sorted by
size / weight, the first k sources stop and the others stand at one level.

Only DataFrame functions are used. A source is not one group: its keys are cut into ranges, 16 a shuffle
partition and `BUCKETS` at least, whose sums are added up across the source (one row a range) and give each range its
offset, so each range sorts and sums alone. Words are counted in one scan, whose slim rows are written to the shared
folder; only they are read twice. What runs in one task is one row for each source.

Nulls and oddities: a null text has size 0. Sources go by code point, null last, and a null source is
one of its own. Weights below `floor`, or null, count as `floor`. Rows alike in id and text have equal keys
and stand in any order; as they are alike, results don't differ. An empty table gives an empty
result; a source of size 0 has target 0. A very long text is one row like others; its words are counted in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.shared import cut

BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_quality(text: Column, size: Column) -> Column:
    """1.0 for texts of 20 words or more, 3 to 10 characters each on average with the gaps; else 0.25."""
    return F.when((size >= 20) & F.length(text).between(size * 3, size * 10), 1.0).otherwise(0.25)


def source_targets(sums: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size), by water-filling."""
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("source_key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sums.withColumn("w", dealt).withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("left", F.col("total") * float(share[0]) / float(share[1]) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("shares", F.sum("w").over(after))
    # The first source, in this order, that its level doesn't fill: it and all after it stand at that level.
    rows = rows.withColumn("place", F.row_number().over(level))
    opened = F.when(F.col("left") * F.col("w") / F.col("shares") < F.col("cap"), F.struct("place", "left", "shares"))
    rows = rows.withColumn("first", F.min(opened).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(F.col("first.left") * F.col("w") / F.col("first.shares"))
    return rows.select("source_key", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (150, 100),
    most: int = 2,
    quality: Column | None = None,
    floor: float = 0.25,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of `docs`: id, size, source_size, target, copies, taken, and the columns `keep`.

    `copies` is how often the mix holds the document and taken = copies * size. `quality` is a column of
    weights over `docs`, by default `plain_quality`.
    """
    size = words(F.col(text))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias("source_key"), size.alias("size"), *(F.col(k).alias(f"keep_{k}") for k in keep), (plain_quality(F.col(text), size) if quality is None else quality).cast("double").alias("quality"), F.xxhash64(F.col(text)).alias("body"))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.col("body").cast("string"))), 1, 13), 16, 10).cast("double")
    rows = rows.withColumn("key", -F.log((drawn + 0.5) / float(1 << 52)) / F.greatest(F.coalesce("quality", F.lit(floor)), F.lit(floor)))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * floor)) * max(BUCKETS, 16 * partitions)).cast("int")).drop("quality")
    rows = cut(rows, "sized")
    ranges = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    offset = F.coalesce(F.sum("range_size").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source_key", "bucket", offset.alias("offset")).join(targets, "source_key")
    own = Window.partitionBy("source_key", "bucket").orderBy("key", "size", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, ["source_key", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    picked = (F.col("before") < rest) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    rows = rows.withColumn("epochs", epochs).withColumn("copies", (F.col("epochs") + picked.cast("long")).cast("long"))
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"keep_{k}").alias(k) for k in keep))
