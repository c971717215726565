"""Request preflight: encoding, limits, counts, maxima and stream identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import TOKEN


def split_pair(context: Column, continuation: Column) -> tuple[Column, Column]:
    """(context, continuation) with the context's trailing white space moved over; an empty context is an error."""
    checked = F.when(F.coalesce(F.length(context), F.lit(0)) == 0, F.raise_error(F.lit("empty context"))).otherwise(context)
    bare = F.regexp_replace(checked, r"(?U)\s+$", "")
    return bare, F.concat(F.substring(context, F.length(bare) + 1, F.length(context)), continuation)


def encode_requests(rows: DataFrame, default_reserve: int = 256) -> DataFrame:
    """Adds rendered, n_tokens, context_tokens and reserve to rows of request_type, context, continuation, max_gen_toks."""
    like, made = F.col("request_type") == "loglikelihood", F.col("request_type") == "generate_until"
    context, continuation = split_pair(F.when(like, F.col("context")).otherwise(F.lit("-")), F.col("continuation"))
    rendered = F.when(like, F.concat(context, continuation)).when(made, F.col("context")).otherwise(F.raise_error(F.concat(F.lit("unexpected request type: "), F.coalesce("request_type", F.lit("null")))))
    out = rows.withColumn("rendered", rendered).withColumn("n_tokens", F.regexp_count("rendered", F.lit(TOKEN)))
    out = out.withColumn("context_tokens", F.when(like, F.regexp_count(context, F.lit(TOKEN))))
    return out.withColumn("reserve", F.when(like, 0).otherwise(F.coalesce("max_gen_toks", F.lit(default_reserve))))


def truncation_violations(requests: DataFrame, context_length: int) -> DataFrame:
    """Requests whose tokens and reserve pass the limit; log-likelihoods have one token less."""
    limit = F.when(F.col("request_type") == "loglikelihood", context_length - 1).otherwise(context_length)
    total = F.col("n_tokens") + F.col("reserve")
    return requests.where(total > limit).select(F.lit("truncation").alias("rule"), F.concat_ws("/", "task", "doc_id").alias("key"), limit.alias("expected"), total.alias("observed"))


def task_maxima(requests: DataFrame) -> DataFrame:
    """Documents and the largest tokens plus reserve of each task."""
    return requests.groupBy("task").agg(F.count_distinct("doc_id").alias("documents"), F.max(F.col("n_tokens") + F.col("reserve")).alias("maximum_tokens"))


def group_count_violations(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Groups whose document count isn't the expected one, either side missing included."""
    both = expected.join(counts, key, "full").where(~F.col("expected").eqNullSafe(F.col("observed")))
    return both.select(F.lit("document_count").alias("rule"), F.col(key).alias("key"), "expected", "observed")


def largest_request(requests: DataFrame, request_type: str = "loglikelihood") -> DataFrame:
    """The longest request of a type, the first of equals by seq."""
    rank = F.row_number().over(Window.orderBy(F.desc("n_tokens"), "seq"))
    top = requests.where(F.col("request_type") == request_type).orderBy(F.desc("n_tokens"), "seq").limit(1)
    return top.withColumn("rank", rank).drop("rank")


def stream_digest(requests: DataFrame, by: list[str], block: int = 4096) -> DataFrame:
    """Per group: request_count, maximum_tokens and a SHA-256 over its requests in order of seq, a number from 0 or so on.

    A request's digest is that of task, type and text, each behind its length in bytes, and of its two counts. Digests
    are folded in two levels, `block` numbers of seq and then the blocks, so no task holds more than a block's digests
    or one digest a block; texts never leave their rows.
    """
    framed = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    own = F.sha2(F.concat(*(framed(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("task", "request_type", "rendered", "n_tokens", "reserve"))), 256)
    folded = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256)
    rows = requests.select(*dict.fromkeys([*by, "seq"]), (F.col("n_tokens") + F.col("reserve")).alias("total"), own.alias("digest"), F.floor(F.col("seq") / block).alias("block"))
    blocks = rows.groupBy(*by, "block").agg(F.count("*").alias("n"), F.max("total").alias("most"), folded("seq").alias("digest"))
    return blocks.groupBy(*by).agg(F.sum("n").alias("request_count"), F.max("most").cast("long").alias("maximum_tokens"), folded("block").alias("stream_sha256"))


def stream_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two request streams has, repeats counted; empty means identical."""
    l, r = left.select(*columns), right.select(*columns)  # noqa: E741
    return l.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right")))


def logprob_summary(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: scored tokens, and the continuation's tokens and log-probability; an error where incomplete.

    `rows`: key, token_ids, prompt_token_ids, logprobs (array of doubles, the first null), context_tokens.
    """
    complete = (F.col("token_ids") == F.col("prompt_token_ids")) & (F.size("logprobs") == F.size("token_ids")) & F.get("logprobs", F.lit(0)).isNull()
    tail = F.slice("logprobs", 2, F.greatest(F.size("logprobs") - 1, F.lit(0)))
    finite = F.forall(tail, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = F.when(F.coalesce(complete & finite, F.lit(False)), F.col("context_tokens")).otherwise(F.raise_error(F.concat(F.lit("incomplete log-probabilities: "), F.col(key).cast("string"))))
    scored = rows.withColumn("from", checked)
    said = F.slice(F.col("logprobs"), F.greatest(F.col("from"), F.lit(1)) + 1, F.size("logprobs"))
    return scored.select(key, (F.size("logprobs") - 1).alias("tokens_scored"), F.size(said).alias("continuation_tokens"), F.aggregate(said, F.lit(0.0), lambda a, x: a + x).alias("continuation_logprob"))
