"""Log mining: ordered failure classes, required markers and values that must be single."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the failure classes, in the order in which they are tried.
FAILURES = {
    "allocator_oom_warning_detected": r"(?im)^.*(?:\bWARNING\b|\[W[0-9]+|CUDACachingAllocator|allocator warning).*\bOOM\b.*$",
    "runtime_exception_detected": r"(?im)(?:\bERROR\b.*(?:\bexception\b|(?:Error|Exception):)|^(?:[A-Za-z_][\w.]*)(?:Error|Exception):)",
    "runtime_truncation_detected": r"(?i)exceeds model.s max length|left truncated|truncating to last|truncating context",
}
#: What a healthy start says.
MARKERS = {
    "native_kernel_not_observed": "Selected CutlassInt8ScaledMMLinearKernel for CompressedTensorsW8A8Int8",
    "text_only_not_observed": "running in text-only mode.",
}
#: How a start reports its cache and its chunks.
CAPACITY = r"GPU KV cache size:\s*([0-9,]+) tokens"
CHUNK = r"Chunked prefill is enabled with max_num_batched_tokens=([0-9,]+)\."


def failure_class(text: Column) -> Column:
    """The first failure class whose pattern the text has; null for a clean log."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in FAILURES.items()])


def reported_numbers(text: Column, pattern: str) -> Column:
    """The distinct numbers that a pattern's group reports, commas dropped, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))))


def single_number(text: Column, pattern: str, what: str) -> Column:
    """The one number reported; an error if none or several are."""
    found = reported_numbers(text, pattern)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit(f"expected one {what}")).cast("long"))


def log_violations(logs: DataFrame, key: str, text: str, chunk: int, least_capacity: int) -> DataFrame:
    """(rule, key, expected, observed) of each log against the start-up gate; nothing for a clean one."""
    log = F.col(text)
    capacity, chunks = reported_numbers(log, CAPACITY), reported_numbers(log, CHUNK)
    rule = lambda test, name, expected, observed: F.when(test, F.struct(F.lit(name).alias("rule"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed")))
    none = F.lit(None).cast("string")
    failed = F.when(failure_class(log).isNotNull(), F.struct(failure_class(log).alias("rule"), none.alias("expected"), none.alias("observed")))
    tests = [failed, *[rule(~log.contains(marker), name, F.lit(marker), none) for name, marker in MARKERS.items()]]
    tests.append(rule(~chunks.eqNullSafe(F.array(F.lit(chunk).cast("long"))), "chunked_prefill", F.lit(chunk), F.array_join(chunks.cast("array<string>"), ",")))
    tests.append(rule(F.size(capacity) != 1, "kv_capacity_reports", F.lit(1), F.size(capacity)))
    tests.append(rule((F.size(capacity) == 1) & (F.get(capacity, F.lit(0)) < least_capacity), "kv_capacity", F.lit(least_capacity), F.get(capacity, F.lit(0))))
    return logs.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*tests))).alias("v")).select("v.rule", "key", "v.expected", "v.observed")


def redacted_error(message: Column) -> Column:
    """An exception's type without its text."""
    return F.nullif(F.regexp_extract(message, r"^\s*([A-Za-z_][\w.]*)", 1), F.lit(""))
