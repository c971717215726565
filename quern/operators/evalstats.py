"""Paired evaluation: strict pairing, deltas, bootstrap intervals, outcome tables and the decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.shared import cut

#: Schema of a sample: the metric's value of one document of one task.
SAMPLES = "task string, doc_id long, doc_hash string, value double"


def pick_metric(metrics: Column, name: str) -> Column:
    """The one metric named `name` or `name,...` of a map; an error unless there is one and it is finite."""
    found = F.map_values(F.map_filter(metrics, lambda k, _: (k == name) | F.startswith(k, F.lit(f"{name},"))))
    value = F.get(found, F.lit(0))
    bad = (F.size(found) != 1) | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"expected one finite {name!r} metric"))).otherwise(value)


def headline(groups: Column, results: Column, task: str, name: str) -> Column:
    """The task's metric from the group results, else from the single ones."""
    return pick_metric(F.coalesce(F.try_element_at(groups, F.lit(task)), F.try_element_at(results, F.lit(task))), name)


def pairing_violations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(rule, key, expected, observed) wherever two sample tables aren't the same documents of the same tasks."""
    key = F.concat_ws("/", "task", "doc_id")
    twice = lambda rows, side: rows.groupBy("task", "doc_id").count().where("count > 1").select(F.lit(f"duplicate_{side}").alias("rule"), key.alias("key"), F.lit("1").alias("expected"), F.col("count").cast("string").alias("observed"))
    tasks = left.select("task").distinct().withColumn("l", F.lit(True)).join(right.select("task").distinct().withColumn("r", F.lit(True)), "task", "full")
    strata = tasks.where("l is null or r is null").select(F.lit("task_strata").alias("rule"), F.col("task").alias("key"), F.lit("both").alias("expected"), F.when(F.col("l").isNull(), "right only").otherwise("left only").alias("observed"))
    shared = tasks.where("l and r").select("task")
    both = left.join(shared, "task").select("task", "doc_id", F.col("doc_hash").alias("left_hash"), F.lit(True).alias("l")).join(right.join(shared, "task").select("task", "doc_id", F.col("doc_hash").alias("right_hash"), F.lit(True).alias("r")), ["task", "doc_id"], "full")
    ids = both.where("l is null or r is null").select(F.lit("document_ids").alias("rule"), key.alias("key"), F.lit("both").alias("expected"), F.when(F.col("l").isNull(), "right only").otherwise("left only").alias("observed"))
    hashes = both.where("l and r and not (left_hash <=> right_hash)").select(F.lit("document_hash").alias("rule"), key.alias("key"), F.col("left_hash").alias("expected"), F.col("right_hash").alias("observed"))
    return twice(left, "left").unionByName(twice(right, "right")).unionByName(strata).unionByName(ids).unionByName(hashes)


def paired_deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(task, doc_id, delta) of pairs by task, id and hash; run `pairing_violations` first."""
    return left.select("task", "doc_id", "doc_hash", F.col("value").alias("l")).join(right.select("task", "doc_id", "doc_hash", F.col("value").alias("r")), ["task", "doc_id", "doc_hash"]).select("task", "doc_id", (F.col("l") - F.col("r")).alias("delta"))


def pair_by_content(left: DataFrame, right: DataFrame, content: list[str]) -> DataFrame:
    """(content_digest, left_value, right_value): pairs by the documents' content, whatever their ids say."""
    name = F.sha2(F.to_json(F.struct(*content)), 256).alias("content_digest")
    return left.select(name, F.col("value").alias("left_value")).join(right.select(name, F.col("value").alias("right_value")), "content_digest")


def delta_summary(deltas: DataFrame, by: str = "task") -> DataFrame:
    """Documents and mean delta of each stratum."""
    return deltas.groupBy(by).agg(F.count("*").alias("documents"), F.avg("delta").alias("mean_delta"))


def retention(summary: DataFrame, macro_least: float = -0.02, each_least: float = -0.05) -> DataFrame:
    """One row: macro_delta and whether it and every group reach their thresholds."""
    found = summary.agg(F.avg("mean_delta").alias("macro_delta"), F.bool_and(F.col("mean_delta") >= each_least).alias("each_ok"))
    return found.select("macro_delta", F.coalesce((F.col("macro_delta") >= macro_least) & F.col("each_ok"), F.lit(False)).alias("accepted"))


def bootstrap(deltas: DataFrame, group: list[str], stratum: str, order: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Per group: 2.5 and 97.5 % bounds of the mean delta, resampled within strata, and the number of documents.

    One generator serves a group's strata in sorted order, so a group is one task; its rows are the paired
    documents of one benchmark. Replicates are drawn stratum by stratum, each in its turn.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([stratum, order], kind="stable")
        strata = [x["delta"].to_numpy(np.float64) for _, x in pdf.groupby(stratum, sort=True)]
        rng, total = np.random.default_rng(seed), len(pdf)
        draws = np.array([sum(float(v[rng.integers(0, len(v), size=len(v))].sum()) for v in strata) for _ in range(replicates)]) / total
        low, high = np.quantile(draws, [0.025, 0.975])
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "low": [low], "high": [high], "documents": [total]})

    types = ", ".join(f"{g} {deltas.schema[g].dataType.simpleString()}" for g in group)
    return deltas.select(*group, stratum, order, F.col("delta").cast("double").alias("delta")).groupBy(*group).applyInPandas(run, f"{types}, low double, high double, documents long")


def _stream(seed: int, stratum: int, node: int, chunk: int) -> np.random.Generator:
    """A stream of random numbers of its own for each (stratum, node, chunk of replicates): counters, not a state that is passed on."""
    return np.random.Generator(np.random.Philox(key=np.array([stratum & (2**64 - 1), (seed << 40) ^ node], np.uint64), counter=[0, 0, 0, chunk]))


def block_sums(values: np.ndarray, total: int, path: list[tuple[int, int, bool]], stratum: int, block: int, chunk: int, size: int, seed: int) -> np.ndarray:
    """Sums over one block of `size` replicates' draws from its stratum.

    `total` draws fall on the blocks as if one by one: at each node of a binary tree of blocks, given from the root down in
    `path` as (rows of the left child, rows of the node, whether this block is on the left), a binomial number of those that
    reach it goes left. Nodes have the numbers of a heap, so all blocks below one agree on it.
    """
    left, node = np.full(size, total, np.int64), 1
    for on_left, whole, goes_left in path:
        part = _stream(seed, stratum, node, chunk).binomial(left, on_left / whole) if whole else left * 0
        left = part if goes_left else left - part
        node = 2 * node + (not goes_left)
    rng = _stream(seed, stratum, (1 << 39) | block, chunk)
    return np.array([values[rng.integers(0, len(values), n)].sum() if n else 0.0 for n in left.tolist()])


def bootstrap_in_blocks(deltas: DataFrame, group: list[str], stratum: str, order: str, replicates: int = 10_000, seed: int = 42, block_rows: int = 1 << 16, chunk: int = 500) -> DataFrame:
    """As `bootstrap`, for strata of any size and replicates over all tasks; its random streams are its own.

    A stratum is cut by a hash of `order` to 2^k blocks of about `block_rows` rows, and replicates to chunks. A task has one
    block and one chunk at a time: it draws how many of a replicate's draws fall on its block and which rows they are, from
    streams counted by stratum, node and chunk, and adds them up. Sums of blocks meet for each replicate, one row a task,
    and quantiles are taken of those.
    """
    key = F.xxhash64(*group, stratum)
    rows = deltas.select(*group, key.alias("stratum__"), F.col(order).alias("order__"), F.col("delta").cast("double").alias("delta"))
    sizes = rows.groupBy("stratum__").agg(F.count("*").alias("total__"))
    sizes = sizes.withColumn("bits__", F.greatest(F.ceil(F.log2(F.col("total__") / block_rows)), F.lit(0)).cast("int"))
    rows = cut(rows.join(sizes, "stratum__").withColumn("block__", F.when(F.col("bits__") > 0, F.expr("shiftrightunsigned(xxhash64(order__), 64 - bits__)")).otherwise(F.lit(0))), "blocks")
    most = rows.agg(F.max("bits__")).first()[0] or 0
    blocks = rows.groupBy(*group, "stratum__", "total__", "bits__", "block__").agg(F.transform(F.array_sort(F.collect_list(F.struct("order__", "delta"))), lambda x: x["delta"]).alias("values__"))
    paths = rows.groupBy("stratum__", "bits__", "block__").agg(F.count("*").alias("n")).withColumn("path__", F.array().cast("array<struct<l:bigint,n:bigint,left:boolean>>"))
    for level in range(most):
        # Nodes of this level: the leading bits of the block; the next bit says which child.
        up = paths.withColumn("node", F.expr(f"shiftright(block__, greatest(bits__ - {level}, 0))")).withColumn("bit", F.expr(f"shiftright(block__, greatest(bits__ - {level + 1}, 0)) & 1"))
        whole = up.where(f"bits__ > {level}").groupBy("stratum__", "node").agg(F.sum("n").alias("whole"), F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("l"))
        step = F.struct("l", F.col("whole").alias("n"), (F.col("bit") == 0).alias("left"))
        paths = cut(up.join(whole, ["stratum__", "node"], "left").withColumn("path__", F.when(F.col("bits__") > level, F.concat("path__", F.array(step))).otherwise(F.col("path__"))).drop("node", "bit", "whole", "l"), "paths")
    work = blocks.join(paths.select("stratum__", "block__", "path__"), ["stratum__", "block__"]).withColumn("chunk__", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // chunk) - 1))))
    work = work.repartition("stratum__", "block__", "chunk__")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for row in frame.to_dict("records"):
                size = min(chunk, replicates - row["chunk__"] * chunk)
                path = [(p["l"], p["n"], p["left"]) for p in row["path__"]]
                own = block_sums(np.asarray(row["values__"], np.float64), int(row["total__"]), path, int(row["stratum__"]), int(row["block__"]), int(row["chunk__"]), size, seed)
                at = (*(row[g] for g in group), row["chunk__"])
                sums[at] = sums[at] + own if at in sums else own
        for at, own in sums.items():
            yield pd.DataFrame({**{g: pd.Series([at[i]] * len(own), dtype=object) for i, g in enumerate(group)}, "replicate": at[-1] * chunk + np.arange(len(own)), "sum": own})

    types = ", ".join(f"{g} {deltas.schema[g].dataType.simpleString()}" for g in group)
    sums = work.mapInPandas(run, f"{types}, replicate long, sum double").groupBy(*group, "replicate").agg(F.sum("sum").alias("sum"))
    counts = rows.groupBy(*group).agg(F.count("*").alias("documents"))
    drawn = sums.groupBy(*group).agg(F.percentile("sum", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    both = counts.join(drawn, group)
    return both.select(*group, (F.get("q", F.lit(0)) / F.col("documents")).alias("low"), (F.get("q", F.lit(1)) / F.col("documents")).alias("high"), "documents")


def outcome_table(pairs: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """Counts of both, only left, only right and neither passing."""
    l, r = F.col(left) > 0, F.col(right) > 0  # noqa: E741
    return pairs.groupBy(*(by or [])).agg(F.count_if(l & r).alias("both_pass"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"), F.count_if(~l & ~r).alias("neither"))


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Exact two-sided p of a split of disagreements: twice the smaller binomial tail at 1/2, at most 1.

    Terms are built one from another in logarithms, so large counts don't underflow.
    """
    n, k = left_only + right_only, F.least(left_only, right_only)
    start = F.struct((F.lit(0.0) - n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")), lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def constraint_counts(rows: DataFrame, kinds: str, passes: str, by: list[str] | None = None) -> DataFrame:
    """Checks and passes of each kind over exploded instruction lists."""
    each = rows.select(*(by or []), F.explode(F.arrays_zip(F.col(kinds).alias("kind"), F.col(passes).alias("passed"))).alias("x"))
    return each.groupBy(*(by or []), F.col("x.kind").alias("kind")).agg(F.count("*").alias("checks"), F.count_if(F.col("x.passed")).alias("passes"))


def strict_pass(passes: Column) -> Column:
    """All instructions of a prompt pass."""
    return F.forall(passes, lambda p: p)


def accuracy(rows: DataFrame, passed: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((F.col(passed) > 0).cast("double")).alias("accuracy"))


def decision(status: DataFrame) -> DataFrame:
    """One row: decision and blocker.

    `status`, one row: scope (paired or candidate-only), missing_candidate and missing_baseline (arrays of names),
    macro_delta and accepted of the pairs.
    """
    only = "candidate_scores_only_no_retention_or_deployment_recommendation"
    absent, base = F.size("missing_candidate") > 0, F.size("missing_baseline") > 0
    made = F.when(absent, "incomplete").when((F.col("scope") == "candidate-only") | base, only).when(F.col("accepted"), "retention_accepted").when(F.col("accepted").isNotNull(), "retention_rejected").otherwise("incomplete")
    named = F.when(absent, F.concat(F.lit("missing candidate groups: "), F.array_join("missing_candidate", ", "))).when((F.col("scope") != "candidate-only") & base, F.concat(F.lit("baseline comparison incomplete: "), F.array_join("missing_baseline", ", ")))
    return status.select(made.alias("decision"), named.alias("blocker"), "macro_delta")
