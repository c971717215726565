"""Connected components of a graph given as a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.shared import cut_to, drop_path, new_path


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component: the least node it reaches.

    `edges` has two columns of one ordered type, `u` and `v`; loops and repeated edges are
    allowed, edges with a null end are left out. Large-star and small-star rounds alternate until
    nothing changes, which takes a number of rounds logarithmic in the graph's size. A round
    aggregates by node and joins the minimum back, so that no node's neighbours are ever gathered;
    each round is written to the shared folder and replaces the one before.
    """
    spark, seen = edges.sparkSession, None
    path = new_path(spark, "edges")
    now = cut_to(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), path)
    for _ in range(most_rounds):
        last, path = path, new_path(spark, "edges")
        now = cut_to(_small_star(_large_star(now)).distinct(), path)
        drop_path(spark, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
