"""Corpus construction: extraction, filters, seeded order, token budgets and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.median import exact_median, with_groups
from quern.functions.shared import cut
from quern.functions.text import TOKEN, first_present, let, shuffled_key

#: Licences a source with licences may have.
OPEN_LICENSES = ("MIT", "Apache-2.0", "Apache 2.0", "BSD-3-Clause")
#: Splits by preference where a source names none.
PREFERRED_SPLITS = ("train", "train_sft", "train_sft_short")


def render_turns(messages: Column) -> Column:
    """`role: content` lines of an array of (role, content); empty contents are left out, null if none is left."""
    said = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    lines = F.transform(said, lambda m: F.concat(F.coalesce(m["role"], F.lit("unknown")), F.lit(": "), m["content"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def join_parts(parts: Column) -> Column:
    """The content of a message whose content is a list of (text) parts."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def render_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, rendered): the turns of each conversation in order, null if none has text."""
    gathered = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("messages"))
    return gathered.select(key, render_turns(F.col("messages")).alias("rendered"))


def extract_text(messages: Column | None = None, text: Column | None = None, conversations: Column | None = None, asked: Column | None = None, answered: Column | None = None) -> Column:
    """The first of messages, text, conversations and the input/output pair that renders; null if none does."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    found = []
    if messages is not None:
        found.append(render_turns(messages))
    if text is not None:
        found.append(F.when(~blank(text), text))
    if conversations is not None:
        found.append(render_turns(conversations))
    if asked is not None:
        pair = F.when(blank(answered), asked).otherwise(F.concat_ws("\n", asked, answered)) if answered is not None else asked
        found.append(F.when(~blank(asked), pair))
    return F.coalesce(*found)


def licensed(source: Column, license: Column, of: str, allowed: tuple[str, ...] = OPEN_LICENSES) -> Column:
    """Rows of the source `of` need an allowed licence, a null one isn't; other rows pass."""
    return (source != of) | F.coalesce(license.isin(*allowed), F.lit(False))


def task_identity(repo: Column, candidates: list[Column], prompt: Column) -> Column:
    """`repo:task` with the first present candidate, else the prompt's digest."""
    return F.concat(repo, F.lit(":"), F.coalesce(first_present(*candidates), F.sha2(prompt, 256)))


def issue_prompt(issues: Column, title: Column, body: Column) -> Column:
    """Title and body of each issue by lines; the row's own where all are blank."""
    told = F.array_join(F.transform(issues, lambda i: F.concat(F.coalesce(i["title"], F.lit("")), F.lit("\n"), F.coalesce(i["body"], F.lit("")))), "\n")
    return F.when(F.trim(F.coalesce(told, F.lit(""))) == "", F.concat(title, F.lit("\n"), body)).otherwise(told)


def heldout_case(suite: str, rows: DataFrame, ids: list[str], prompt: str, codes: list[str]) -> DataFrame:
    """(suite, id, prompt, code) with the first present id, else the row's place, and the first present code or ''."""
    place = F.row_number().over(Window.orderBy(*[F.col(c) for c in ids], prompt)) - 1
    return rows.select(F.lit(suite).alias("suite"), F.coalesce(first_present(*map(F.col, ids)), place.cast("string")).alias("id"), F.col(prompt).alias("prompt"), F.coalesce(first_present(*map(F.col, codes)), F.lit("")).alias("code"))


def token_count(text: Column, most: int | None = None) -> Column:
    """Default tokens of a text after truncation to `most`."""
    n = F.regexp_count(text, F.lit(TOKEN))
    return F.least(n, F.lit(most)) if most else n


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def examined(rows: DataFrame, cap: int, id: str, by: list[str], seed: int = 42) -> DataFrame:
    """The first `cap` rows of each source in seeded order, with their `place` from 0: a cap on what is looked at, before other filters."""
    keyed = rows.withColumn("key__", shuffled_key(F.col(id), seed)).withColumn("one__", F.lit(1))
    return budget_take(keyed, cap, "one__", [F.col("key__"), F.col(id)], by, key=F.col("key__")).withColumnRenamed("tokens_before", "place").drop("key__", "one__")


def within_examination(rows: DataFrame, examined_rows: DataFrame, id: str, by: str, seed: int = 42) -> DataFrame:
    """Those of `rows` that `examined_rows`, the result of `examined` on their slim columns, has.

    Each source's last examined key is broadcast, one row a source, so wide rows aren't shuffled.
    """
    key = F.struct(shuffled_key(F.col(id), seed).alias("key"), F.col(id).alias("id"))
    last = examined_rows.groupBy(F.col(by).alias("by__")).agg(F.max(key).alias("last__"))
    return rows.join(F.broadcast(last), F.col(by).eqNullSafe(F.col("by__"))).where(key <= F.col("last__")).drop("by__", "last__")


def budget_take(rows: DataFrame, target: Column | int, tokens: str, order: list[Column], by: list[str], buckets: int = 256, key: Column | None = None) -> DataFrame:
    """Rows in order while the sum of those before is under the target; the one that crosses it is taken.

    A source isn't summed as one group. Rows are cut by `key`, hexadecimal text that leads the order, into
    256 ranges; the ranges' sums add up across the source, one row a range, and only rows of the range in
    which the budget ends are ordered.
    """
    key = order[0] if key is None else key
    ranged = rows.withColumn("range__", F.conv(F.substring(key, 1, 2), 16, 10).cast("int"))
    sums = ranged.groupBy(*by, "range__").agg(F.sum(tokens).alias("sum__"))
    before = F.sum("sum__").over(Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"by__{c}") for c in by], F.col("range__").alias("at__"), F.coalesce(before, F.lit(0)).alias("before__"))
    goal = F.lit(target) if not isinstance(target, Column) else target
    same = F.col("range__") == F.col("at__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"by__{c}"))
    ranged = ranged.join(sums, same).where(F.col("before__") < goal).drop("at__", *[f"by__{c}" for c in by])
    own = F.sum(tokens).over(Window.partitionBy(*by, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("tokens_before", F.col("before__") + F.coalesce(own, F.lit(0)))
    return ranged.where(F.col("tokens_before") < goal).drop("range__", "before__")


def source_summary(rows: DataFrame, source: str, tokens: str) -> DataFrame:
    """Per source: rows, tokens, shortest, longest and mean length, and the share of all tokens."""
    found = rows.groupBy(source).agg(F.count("*").alias("n_rows"), F.sum(tokens).alias("tokens"), F.min(tokens).alias("length_min"), F.max(tokens).alias("length_max"), F.avg(tokens).alias("length_mean"))
    total = F.sum("tokens").over(Window.partitionBy())
    return found.withColumn("token_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))


def length_statistics(rows: DataFrame, tokens: str, cap: int, by: list[str] | None = None) -> DataFrame:
    """Count, shortest, longest, mean and exact median length, and how many are at the cap."""
    slim = cut(rows.select(*(by or []), tokens), "lengths")
    found = slim.groupBy(*(by or [])).agg(F.count("*").alias("sample_count"), F.min(tokens).alias("minimum"), F.max(tokens).alias("maximum"), F.avg(tokens).alias("mean"), F.count_if(F.col(tokens) == cap).alias("at_maximum"))
    return with_groups(found, exact_median(slim, tokens, by or []), by or []).select(*(by or []), "sample_count", "minimum", "maximum", "mean", "median", "at_maximum")


def bucket_pivot(rows: DataFrame, source: str, tokens: str, buckets: dict[str, tuple[int, int]]) -> DataFrame:
    """Tokens of each source in each inclusive length range, 0 where none."""
    name = F.lit(None).cast("string")
    for bucket, (low, high) in buckets.items():
        name = F.when(F.col(tokens).between(low, high), bucket).otherwise(name)
    made = rows.withColumn("bucket__", name).groupBy(source)
    return made.agg(*[F.coalesce(F.sum(F.when(F.col("bucket__") == b, F.col(tokens))), F.lit(0)).alias(b) for b in buckets])


def shortfalls(totals: DataFrame, targets: DataFrame, key: list[str], least: float = 0.9) -> DataFrame:
    """(rule, key, expected, observed) where a total is under `least` of its target; a missing total counts as 0."""
    both = targets.join(totals, key, "left").withColumn("observed", F.coalesce("tokens", F.lit(0)).cast("double"))
    return both.where(F.col("observed") < F.col("target") * least).select(F.lit("insufficient_tokens").alias("rule"), F.concat_ws(":", *key).alias("key"), F.col("target").cast("double").alias("expected"), "observed")


def out_of_range(totals: DataFrame, low: int, high: int) -> DataFrame:
    """A violation where the grand total of `tokens` lies outside low..high."""
    return totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).where(~F.col("t").between(low, high)).select(F.lit("total_tokens_out_of_range").alias("rule"), F.lit("total").alias("key"), F.lit(float(low)).alias("expected"), F.col("t").cast("double").alias("observed"))


def share_violations(summary: DataFrame, shares: DataFrame, source: str, tolerance: float = 0.03) -> DataFrame:
    """Sources whose share of tokens is off its target by more than the tolerance."""
    both = shares.join(summary.select(source, "token_share"), source, "left").withColumn("observed", F.coalesce("token_share", F.lit(0.0)))
    return both.where(F.abs(F.col("observed") - F.col("share")) > tolerance).select(F.lit("token_share").alias("rule"), F.col(source).alias("key"), F.col("share").alias("expected"), "observed")


def shortest_and_longest(rows: DataFrame, length: str, position: str, shortest: int = 4) -> DataFrame:
    """The `shortest` shortest rows and the longest, once each, ties by position."""
    first = rows.orderBy(length, position).limit(shortest)
    last = rows.orderBy(F.desc(length), position).limit(1)
    return first.unionByName(last).dropDuplicates([position])


def fixed_subset(rows: DataFrame, id: str, size: int, seed: int = 42) -> DataFrame:
    """All rows, with a flag on the first `size` in seeded order."""
    order = F.struct(shuffled_key(F.col(id), seed).alias("key"), F.col(id).alias("id"))
    chosen = rows.select(id, order.alias("order")).orderBy("order").limit(size).select(id, F.lit(True).alias("chosen"))
    return rows.join(chosen, id, "left").withColumn("in_subset", F.coalesce("chosen", F.lit(False))).drop("chosen")


def repeat_cyclic(rows: DataFrame, count: int, order: str) -> DataFrame:
    """`count` rows: those of a tiny table again and again, with their place."""
    numbered = rows.withColumn("k", F.row_number().over(Window.orderBy(order)) - 1)
    n = numbered.select(F.count("*").over(Window.partitionBy()).alias("n"), "*")
    last = F.greatest(F.lit(count - 1), F.col("k")).cast("long")  # of fewer rows than the table has
    places = n.withColumn("place", F.explode(F.sequence(F.col("k").cast("long"), last, F.col("n").cast("long"))))
    return places.where(F.col("place") < count).drop("n", "k")


def synthetic_ids(spark, rows: int, length: int, multiplier: int = 17, modulus: int = 480, base: int = 1) -> DataFrame:
    """(row, input_ids): base + (row * multiplier + place) mod modulus."""
    places = F.sequence(F.lit(0), F.lit(length - 1))
    return spark.range(rows).select(F.col("id").alias("row"), F.transform(places, lambda p: (F.lit(base) + (F.col("id") * multiplier + p) % modulus).cast("int")).alias("input_ids"))


def largest_fit(unit_tokens: int, prefix_tokens: int, target: int) -> int:
    """How many units fit a prompt of `target` tokens after the prefix; the count is monotone in the units."""
    return max(0, (target - prefix_tokens) // unit_tokens) if unit_tokens > 0 else 0


def prompt_sizes(spark, targets: list[int], unit: str, prefix: str) -> DataFrame:
    """(target, units, tokens): the largest prompt of prefix and repeated unit within each target."""
    goal = spark.createDataFrame([(t,) for t in targets], "target int")
    size = lambda n: token_count(F.concat(F.lit(prefix), F.repeat(F.lit(unit), n)))
    tried = goal.withColumn("units", F.explode(F.sequence(F.lit(0), F.greatest("target", F.lit(1))))).withColumn("tokens", size(F.col("units")))
    fits = tried.where(F.col("tokens") <= F.col("target")).groupBy("target").agg(F.max(F.struct("units", "tokens")).alias("best"))
    return goal.join(fits, "target", "left").select("target", F.coalesce("best.units", F.lit(0)).alias("units"), F.coalesce("best.tokens", F.lit(0)).alias("tokens"))


def preferred_split(available: Column) -> Column:
    """The preferred one of a source's splits, else its first."""
    return F.coalesce(*[F.when(F.array_contains(available, s), F.lit(s)) for s in PREFERRED_SPLITS], F.try_element_at(available, F.lit(1)))


def longest_prefix(lengths: Column, low: int, high: int) -> Column:
    """Of cumulative prefix lengths, the last one within low..high before the first beyond high; null if none."""
    return let(F.filter(lengths, lambda n: n <= high), lambda kept: F.array_max(F.filter(kept, lambda n: n >= low)))


def shuffled_take(rows: DataFrame, id: str, count: int, seed: int = 42) -> DataFrame:
    """The first `count` rows in seeded order, with their place from 0; a top-k, so nothing is sorted whole."""
    key = shuffled_key(F.col(id), seed)
    top = rows.withColumn("key__", key).orderBy("key__", id).limit(count)
    place = F.row_number().over(Window.orderBy("key__", id)) - 1  # over `count` rows at most
    return top.withColumn("place", place).drop("key__")


def frozen_sample(rows: DataFrame, id: str, count: int, seed: int = 42) -> DataFrame:
    """As `shuffled_take`, where fewer rows than asked for are an error."""
    found = shuffled_take(rows, id, count, seed)
    enough = F.count("*").over(Window.partitionBy())
    return found.withColumn("place", F.when(enough == count, F.col("place")).otherwise(F.raise_error(F.lit(f"fewer than {count} rows to sample")).cast("int")))


def executable(*patches: Column) -> Column:
    """Cases whose patches and tests are all present."""
    out = F.lit(True)
    for patch in patches:
        out = out & (F.coalesce(patch, F.lit("")) != "")
    return out


def positions(rows: DataFrame, place: str, count: int) -> DataFrame:
    """The first `count` rows by position."""
    return rows.where(F.col(place) < count)


def due_marks(rows: DataFrame, place: str, total: int, share: float = 0.2) -> DataFrame:
    """Whether a checkpoint is due at each place from 1: every ceil(total * share) ones and at the last."""
    every = max(1, -(-int(total * share * 1000) // 1000))
    return rows.withColumn("due", (F.col(place) % every == 0) | (F.col(place) == total))
