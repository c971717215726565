"""Exact medians by selection: rounds of histograms narrow each group to the values around its middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.shared import cut, cut_to, drop_path, new_path

#: A group with so many candidates at most is ordered at once.
FEW = 4096
#: Pivots of a round: each leaves about a 32nd of the candidates.
PIVOTS = 32


def with_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on columns in which nulls are equal; `right` has other columns besides."""
    other = right.select(*[F.col(c).alias(f"other__{c}") for c in by], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"other__{c}"))
    return left.join(other, same, "left").drop(*[f"other__{c}" for c in by])


def exact_median(rows: DataFrame, value: str, by: list[str], few: int = FEW, pivots: int = PIVOTS) -> DataFrame:
    """(by, median) of the values that aren't null, the mean of the middle two; groups without a value are left out.

    Each round takes pivots from a sketch of bounded size of each group's candidates, counts the candidates at and between
    pivots, one row for each, and keeps the interval in which a middle rank lies; the sketch only steers, counts are
    exact. Candidates shrink by a factor a round, so the last ordering takes `few` rows of a group, whatever its size; a
    middle that lies on a pivot is settled by its count. Candidates aren't copied: a round filters the rows by their group's bounds.
    """
    spark = rows.sparkSession
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    slim = rows.select(key.alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    # A target: the rank (from 1) of a value among the group's candidates, those strictly between low and high.
    state = slim.groupBy("g").agg(F.count("*").alias("n"))
    state = state.select("g", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("rank"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n", F.lit(None).cast("double").alias("found"))
    state, last = cut_to(state, path := new_path(spark, "targets")), path
    inside = "(low is null or v > low) and (high is null or v < high)"
    while not state.where(f"found is null and n > {few}").isEmpty():
        large = state.where(f"found is null and n > {few}").select("g", "rank", "low", "high")
        held = slim.withColumnRenamed("g", "of").join(large, F.col("of").eqNullSafe(F.col("g"))).where(inside)
        sketch = held.groupBy("g", "rank").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [(i + 0.5) / pivots for i in range(pivots)], 1000))).alias("cuts"))
        sketch = cut(sketch.select(F.col("g").alias("sg"), F.col("rank").alias("srank"), "cuts"), "pivots")
        placed = held.join(sketch, F.col("g").eqNullSafe(F.col("sg")) & (F.col("rank") == F.col("srank")))
        below = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        place = below * 2 + F.when(F.get("cuts", below) == F.col("v"), 1).otherwise(0)  # odd: at a pivot
        counts = placed.select("g", "rank", "low", "high", "cuts", place.alias("place")).groupBy("g", "rank", "place").agg(F.count("*").alias("m"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("cuts").alias("cuts"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("g", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("before", before).where("before < rank and rank <= before + m")
        pivot = (F.col("place") / 2).cast("int")
        odd = F.col("place") % 2 == 1
        narrowed = hit.select(
            "g", (F.col("rank") - F.col("before")).alias("rank"),
            F.when(pivot > 0, F.get("cuts", pivot - 1)).otherwise(F.col("low")).alias("low"),
            F.coalesce(F.get("cuts", pivot), F.col("high")).alias("high"), F.col("m").alias("n"), F.when(odd, F.get("cuts", pivot)).alias("found"),
        )
        state = cut_to(state.where(f"found is not null or n <= {few}").unionByName(narrowed), path := new_path(spark, "targets"))
        drop_path(spark, last)
        last = path
    rest = slim.withColumnRenamed("g", "of").join(state.where("found is null"), F.col("of").eqNullSafe(F.col("g"))).where(inside)
    ordered = rest.withColumn("place", F.row_number().over(Window.partitionBy("g", "rank", "low", "high").orderBy("v"))).where("place = rank")
    both = ordered.select("g", "v").unionByName(state.where("found is not null").select("g", F.col("found").alias("v")))
    return both.groupBy("g").agg(F.avg("v").alias("median")).select(*[F.col(f"g.{c}").alias(c) for c in by], "median")
