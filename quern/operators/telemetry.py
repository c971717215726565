"""Telemetry: per-stage rollups and breach alarms over sampled series, and benchmark distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.median import exact_median, with_groups
from quern.functions.shared import cut

#: The sampled series, tab-separated and without a header.
TELEMETRY = "ts string, stage string, mem_kib long, swap_growth_kib long, rss_kib long, vmswap_kib long, gpus string, disk_bytes long, psi_some long, psi_full long, pswpin long, pswpout long"
PAGE_BYTES = 4096


def stage_rollup(samples: DataFrame, order: str = "seq") -> DataFrame:
    """Per stage: samples, first and last time, extremes, element-wise GPU maxima and counter deltas."""
    gpu = lambda k: F.try_element_at(F.split("gpus", ","), F.lit(k + 1)).cast("long")
    ends = lambda c: (F.max_by(c, order) - F.min_by(c, order))
    return samples.groupBy("stage").agg(
        F.count("*").alias("samples"),
        F.min_by("ts", order).alias("first_timestamp"),
        F.max_by("ts", order).alias("last_timestamp"),
        F.min("mem_kib").alias("minimum_mem_available_kib"),
        F.greatest(F.max("swap_growth_kib"), F.lit(0)).alias("maximum_swap_growth_kib"),
        F.greatest(F.max("rss_kib"), F.lit(0)).alias("maximum_process_rss_kib"),
        F.greatest(F.max("vmswap_kib"), F.lit(0)).alias("maximum_process_vmswap_kib"),
        F.array(*[F.greatest(F.max(gpu(k)), F.lit(0)) for k in (0, 1)]).alias("maximum_gpu_memory_mib"),
        F.min("disk_bytes").alias("minimum_disk_available_bytes"),
        ends("psi_some").alias("psi_delta_some_usec"),
        ends("psi_full").alias("psi_delta_full_usec"),
        (ends("pswpin") * PAGE_BYTES).alias("swap_in_delta_bytes"),
        (ends("pswpout") * PAGE_BYTES).alias("swap_out_delta_bytes"),
    )


def series_rollup(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Per series: samples, first and last value by order, extremes and the change from first to last."""
    at = F.struct(*order)
    return rows.groupBy(by).agg(F.count("*").alias("samples"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), (F.max_by(value, at) - F.min_by(value, at)).alias("delta"))


def _scanned(rows: DataFrame, by: str, time: str | None, order: list[str], breach: Column) -> DataFrame:
    """Breaching samples with `island`, the number of samples of the series before that recovered, and, given `time`, `started`, when the run began.

    A series isn't one group. Samples are cut to ranges of (series, order); a range's summary is the number of its
    recoveries and when the run that is open at its end began. Summaries are added up along each series, one row a range, and
    give each range the number of recoveries before it and the start of the run that reaches into it; so each range
    is scanned alone.
    """
    marked = rows.withColumn("breach__", F.coalesce(breach, F.lit(False)))
    marked = cut(marked.repartitionByRange(by, *order).withColumn("range__", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(by, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("local__", F.sum((~F.col("breach__")).cast("long")).over(own))
    at = F.col(time) if time else F.lit(None).cast("timestamp")
    runs = marked.groupBy(by, "range__", "local__").agg(F.min(F.when(F.col("breach__"), at)).alias("began"))
    ends = runs.groupBy(by, "range__").agg(F.max("local__").alias("resets"), F.max_by("began", "local__").alias("began"))
    before = Window.partitionBy("by__").orderBy("range__")
    ends = ends.withColumnRenamed(by, "by__").withColumn("offset__", F.coalesce(F.sum("resets").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn("open", F.min("began").over(Window.partitionBy("by__", F.col("offset__") + F.col("resets")).orderBy("range__")))
    ends = ends.select("by__", F.col("range__").alias("range_of"), "offset__", F.lag("open").over(before).alias("carried__"))
    found = marked.join(ends, F.col(by).eqNullSafe(F.col("by__")) & (F.col("range__") == F.col("range_of"))).where("breach__")
    found = found.withColumn("island", F.col("offset__") + F.col("local__"))
    if time:
        first = F.min(time).over(Window.partitionBy(by, "range__", "local__"))
        found = found.withColumn("started", F.when(F.col("local__") == 0, F.least(first, F.col("carried__"))).otherwise(first))
    return found.drop("by__", "range__", "range_of", "offset__", "carried__", "local__", "breach__")


def consecutive_breaches(rows: DataFrame, by: str, order: list[str], breach: Column, least: int = 5) -> DataFrame:
    """(by, island, samples) of runs of `least` breaching samples or more; one that recovers starts over."""
    return _scanned(rows, by, None, order, breach).groupBy(by, "island").agg(F.count("*").alias("samples")).where(F.col("samples") >= least)


def sustained_breaches(rows: DataFrame, by: str, time: str, order: list[str], reasons: dict[str, Column], seconds: float) -> DataFrame:
    """(by, island, started, raised_at, reasons) at the first sample by which a breach has lasted so long.

    Any of the reasons is a breach; those of the raising sample are joined by `+` in their given order.
    """
    held = {k: F.coalesce(v, F.lit(False)) for k, v in reasons.items()}
    any_of = F.lit(False)
    for v in held.values():
        any_of = any_of | v
    runs = _scanned(rows.withColumn("reasons", F.concat_ws("+", *[F.when(v, k) for k, v in held.items()])), by, time, order, any_of)
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    late = runs.where(at(time) - at("started") >= seconds)
    return late.groupBy(by, "island").agg(F.min("started").alias("started"), F.min(time).alias("raised_at"), F.min_by("reasons", F.struct(*order)).alias("reasons"))


def resource_limits(min_mem_available_gib: int = 8, max_swap_growth_gib: int = 32, sustain_seconds: int = 10) -> dict[str, int]:
    """The guard's limits in bytes and seconds; each is a positive integer, and true is none."""
    given = {"min_mem_available_gib": min_mem_available_gib, "max_swap_growth_gib": max_swap_growth_gib, "sustain_seconds": sustain_seconds}
    for name, value in given.items():
        if type(value) is not int or value <= 0:
            raise ValueError(f"{name} must be a positive integer")
    return {"min_mem_available_bytes": min_mem_available_gib << 30, "max_swap_growth_bytes": max_swap_growth_gib << 30, "sustain_seconds": sustain_seconds}


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, exact median, mean, extremes and population standard deviation."""
    v = F.col(value)
    found = rows.groupBy(*(by or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("population_standard_deviation"))
    found = with_groups(found, exact_median(rows, value, by or []), by or [])
    return found.select(*(by or []), "count", "median", "mean", "minimum", "maximum", "population_standard_deviation")


def stream_timings(chunks: DataFrame, key: str = "request_id") -> DataFrame:
    """Per streamed response: time to the first text, counts of tokens and throughputs.

    `chunks`: key, started, ts (seconds), text, prompt_tokens, completion_tokens (null but on the usage chunk).
    A response without text or usage is an error.
    """
    found = chunks.groupBy(key).agg(F.min("started").alias("started"), F.max("ts").alias("finished"), F.min(F.when(F.coalesce("text", F.lit("")) != "", F.col("ts"))).alias("first"), F.max_by("prompt_tokens", F.when(F.col("prompt_tokens").isNotNull(), F.col("ts"))).alias("prompt_tokens"), F.max_by("completion_tokens", F.when(F.col("completion_tokens").isNotNull(), F.col("ts"))).alias("completion_tokens"))
    whole = F.col("first").isNotNull() & F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    ttft = F.when(whole, F.col("first") - F.col("started")).otherwise(F.raise_error(F.concat(F.lit("no text or usage: "), F.col(key).cast("string"))).cast("double"))
    decode = F.greatest(F.col("finished") - F.col("first"), F.lit(1e-9))
    return found.select(key, ttft.alias("time_to_first_token_seconds"), (F.col("finished") - F.col("started")).alias("total_seconds"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") / F.greatest(F.col("first") - F.col("started"), F.lit(1e-9))).alias("approx_prefill_tokens_per_second"), decode.alias("decode_seconds_after_first_token"), (F.greatest(F.col("completion_tokens") - 1, F.lit(0)) / decode).alias("decode_tokens_per_second"))
