"""Checkpoint metadata as tables: classification, rollups and reconciliation into violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.shared import cut, sized

#: Bytes of each element type of a tensor file.
DTYPE_BYTES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
#: Endings of the names of linear weights.
LINEAR_ENDINGS = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "out_proj", "in_proj_qkv", "in_proj_z", "in_proj_a", "in_proj_b", "linear_fc1", "linear_fc2", "qkv", "attn.proj", "fc")
TENSORS = "name string, shard string, dtype string, shape array<bigint>, start long, end long"


def _named(*rules: tuple[Column, str], default: str) -> Column:
    out = F.lit(default)
    for test, label in reversed(rules):
        out = F.when(test, label).otherwise(out)
    return out


def tensor_kind(name: Column, shape: Column) -> Column:
    """What a tensor is, by its name and rank; the first rule that fits decides."""
    return _named(
        (name.endswith("embed_tokens.weight"), "Embedding"),
        (name == "lm_head.weight", "Linear (lm_head)"),
        (name.contains(".norm") | name.contains("layernorm"), "Normalization"),
        (name.endswith("conv1d.weight"), "Depthwise Conv1d"),
        (name.contains("patch_embed"), "Vision patch projection"),
        ((F.size(shape) == 2) & name.rlike(r"\.(?:" + "|".join(e.replace(".", r"\.") for e in LINEAR_ENDINGS) + r")\.weight$"), "Linear"),
        default="Parameter",
    )


def tensor_component(name: Column) -> Column:
    """Which part of the model a tensor belongs to; the first rule that fits decides."""
    return _named(
        (name.startswith("model.visual."), "vision"),
        (name.startswith("mtp."), "mtp"),
        (name == "lm_head.weight", "lm_head"),
        (name.endswith("embed_tokens.weight"), "embeddings"),
        (name.contains(".linear_attn."), "recurrent_gdn"),
        (name.contains(".self_attn."), "full_attention"),
        (name.contains(".mlp."), "text_mlp"),
        (name.contains(".norm") | name.contains("layernorm"), "normalization"),
        default="other",
    )


def elements(shape: Column) -> Column:
    """Number of elements; a scalar has one."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def classified(tensors: DataFrame) -> DataFrame:
    return tensors.withColumn("kind", tensor_kind(F.col("name"), F.col("shape"))).withColumn("component", tensor_component(F.col("name"))).withColumn("bytes", F.col("end") - F.col("start"))


def tensor_rollup(tensors: DataFrame) -> DataFrame:
    """(grouping, label, tensors, bytes) by dtype, kind and component in one pass."""
    rows = classified(tensors)
    labels = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("label")) for g in ("dtype", "kind", "component")]))
    return rows.select(labels.alias("x"), "bytes").groupBy("x.grouping", "x.label").agg(F.count("*").alias("tensors"), F.sum("bytes").alias("bytes"))


def reconcile(index: DataFrame, tensors: DataFrame) -> DataFrame:
    """(rule, key, expected, observed): the weight map `index` (name, shard) against the shards' headers.

    Rules: absent from headers, absent from the index, in another shard, and names that occur twice.
    """
    there = tensors.groupBy("name").agg(F.count("*").alias("times"), F.max("shard").alias("observed"))
    both = index.select("name", F.col("shard").alias("expected")).join(there, "name", "full")
    rule = F.when(F.col("observed").isNull(), "missing_tensor").when(F.col("expected").isNull(), "unindexed_tensor").when(F.col("expected") != F.col("observed"), "mapping_mismatch")
    found = both.withColumn("rule", rule).where("rule is not null").select("rule", F.col("name").alias("key"), "expected", "observed")
    twice = there.where("times > 1").select(F.lit("duplicate_tensor").alias("rule"), F.col("name").alias("key"), F.lit("1").alias("expected"), F.col("times").cast("string").alias("observed"))
    return found.unionByName(twice)


def byte_violations(tensors: DataFrame) -> DataFrame:
    """Tensors whose offsets and shape disagree; an unknown dtype isn't judged."""
    width = F.create_map(*[F.lit(x) for pair in DTYPE_BYTES.items() for x in pair])
    expected = elements(F.col("shape")) * F.try_element_at(width, F.col("dtype"))
    return tensors.withColumn("expected", expected).where("expected > 0 and expected <> end - start").select(F.lit("tensor_bytes").alias("rule"), F.col("name").alias("key"), F.col("expected").cast("string").alias("expected"), (F.col("end") - F.col("start")).cast("string").alias("observed"))


def region_violations(tensors: DataFrame, shards: DataFrame) -> DataFrame:
    """Shards whose last tensor doesn't end where the file does. `shards`: shard, size_bytes, header_bytes."""
    last = tensors.groupBy("shard").agg(F.max("end").alias("observed"))
    both = shards.join(last, "shard", "left").withColumn("expected", F.col("size_bytes") - 8 - F.col("header_bytes"))
    return both.where("coalesce(observed, 0) <> expected").select(F.lit("data_region").alias("rule"), F.col("shard").alias("key"), F.col("expected").cast("string").alias("expected"), F.coalesce("observed", F.lit(0)).cast("string").alias("observed"))


def shard_differences(index: DataFrame, present: DataFrame) -> DataFrame:
    """Shards that the index names but aren't there, and those there that it doesn't name."""
    wanted, have = index.select("shard").distinct(), present.select("shard").distinct()
    return wanted.join(have, "shard", "left_anti").select(F.lit("missing_shard").alias("rule"), F.col("shard").alias("key")).unionByName(have.join(wanted, "shard", "left_anti").select(F.lit("extra_shard").alias("rule"), F.col("shard").alias("key")))


def matches_pattern(pattern: Column, name: Column) -> Column:
    """`re:` patterns match whole names; others are the name or its dotted ending."""
    return F.when(pattern.startswith("re:"), F.regexp_like(name, F.concat(F.lit("^(?:"), F.substring(pattern, 4, F.length(pattern)), F.lit(")$")))).otherwise((name == pattern) | name.endswith(F.concat(F.lit("."), pattern)))


def resolve_policy(names: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(included names, pattern counts): names that no ignore pattern matches, and what each pattern matched.

    A policy has a handful of patterns; they are tested as expressions on each name, without a join.
    """
    tests = [F.when(matches_pattern(F.lit(p), F.col("name")), p) for p in patterns]
    hit = names.select("name", F.array_compact(F.array(*tests)).alias("matched") if tests else F.array().cast("array<string>").alias("matched"))
    included = hit.where(F.size("matched") == 0).select("name")
    counted = hit.select(F.explode("matched").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    every = names.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    counts = every.join(counted, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n_matched"))
    return included, counts.withColumn("unresolved", (F.col("n_matched") == 0) & ~F.col("pattern").startswith("re:^mtp"))


def target_violations(targets: DataFrame, tensors: DataFrame, families: DataFrame, total: int) -> DataFrame:
    """Families (suffix, expected_count, expected_shape) against targets (name, suffix) and the headers' shapes."""
    shapes = tensors.select(F.regexp_replace("name", r"\.weight$", "").alias("name"), "shape")
    found = targets.join(shapes, "name", "left")
    per = found.join(families, "suffix").groupBy("suffix").agg(F.count("*").alias("n"), F.count_if(~F.col("shape").eqNullSafe(F.col("expected_shape"))).alias("wrong"))
    both = families.join(per, "suffix", "left")
    counts = both.where("coalesce(n, 0) <> expected_count").select(F.lit("family_count").alias("rule"), F.col("suffix").alias("key"), F.col("expected_count").cast("string").alias("expected"), F.coalesce("n", F.lit(0)).cast("string").alias("observed"))
    wrong = both.where("wrong > 0").select(F.lit("family_shape").alias("rule"), F.col("suffix").alias("key"), F.lit("0").alias("expected"), F.col("wrong").cast("string").alias("observed"))
    all_ = targets.agg(F.count("*").alias("n")).where(F.col("n") != total).select(F.lit("target_total").alias("rule"), F.lit("all").alias("key"), F.lit(str(total)).alias("expected"), F.col("n").cast("string").alias("observed"))
    return counts.unionByName(wrong).unionByName(all_)


def storage_estimate(targets: DataFrame, declared_bytes: int, group_size: int = 128) -> DataFrame:
    """One row: weights, packed and scale bytes of 4-bit targets (with shape), and of the whole checkpoint."""
    n = targets.agg(F.coalesce(F.sum(elements(F.col("shape"))), F.lit(0)).alias("weights"))
    n = n.withColumn("packed_bytes", F.floor((F.col("weights") + 1) / 2)).withColumn("scale_bytes", F.ceil(F.col("weights") / group_size) * 2)
    return n.withColumn("checkpoint_bytes", F.lit(declared_bytes) - 2 * F.col("weights") + F.col("packed_bytes") + F.col("scale_bytes"))


def packed_violations(targets: DataFrame, source: DataFrame, output: DataFrame, group_size: int = 128) -> DataFrame:
    """Violations of a packed 4-bit checkpoint's metadata against its source's tensors.

    `targets`: name, shape. Each target's weight becomes packed, scale and shape tensors; all else stays as it was.
    """
    parts = F.explode(F.array(*[F.lit(s) for s in ("weight_packed", "weight_scale", "weight_shape")]))
    made = targets.select("name", "shape", parts.alias("part")).select(F.concat_ws(".", "name", "part").alias("name"), F.col("part"), "shape")
    kept = source.join(targets.select(F.concat(F.col("name"), F.lit(".weight")).alias("name")), "name", "left_anti")
    expected = made.select("name").unionByName(kept.select("name")).withColumn("e", F.lit(True))
    both = expected.join(output.select("name").distinct().withColumn("o", F.lit(True)), "name", "full")
    names = both.where("e is null or o is null").select(F.when(F.col("o").isNull(), "missing_tensor").otherwise("extra_tensor").alias("rule"), F.col("name").alias("key"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("observed"))
    text = lambda dtype, shape: F.concat_ws(" ", dtype, F.to_json(shape))
    form = F.when(F.col("part") == "weight_packed", text(F.lit("I32"), F.array(F.get("shape", F.lit(0)), F.floor(F.get("shape", F.lit(1)) / 8)))).when(F.col("part") == "weight_scale", text(F.lit("BF16"), F.array(F.get("shape", F.lit(0)), F.floor(F.get("shape", F.lit(1)) / group_size))))
    wanted = made.select("name", form.alias("expected")).where("expected is not null").unionByName(kept.select("name", text(F.col("dtype"), F.col("shape")).alias("expected")))
    have = output.select("name", text(F.col("dtype"), F.col("shape")).alias("observed"))
    forms = wanted.join(have, "name").where("expected <> observed").select(F.lit("tensor_form").alias("rule"), F.col("name").alias("key"), "expected", "observed")
    return names.unionByName(forms)


def order_free_identity(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row: file_count, size_bytes and a digest over the sorted records of a manifest."""
    return files.agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*columns)))), "\n"), 256).alias("identity_sha256"))


def manifest_changes(before: DataFrame, after: DataFrame, key: str = "model") -> DataFrame:
    """Models whose identity changed, or that only one of two manifests has."""
    b, a = before.select(key, F.col("identity_sha256").alias("expected")), after.select(key, F.col("identity_sha256").alias("observed"))
    return b.join(a, key, "full").where(~F.col("expected").eqNullSafe(F.col("observed"))).select(F.lit("manifest_identity").alias("rule"), F.col(key).alias("key"), "expected", "observed")


def manifest_tree(files: DataFrame, columns: list[str], key: str = "path", depth: int = 4, step: int = 2) -> DataFrame:
    """(level, node, records, sha256): a hash tree over a manifest's records, from the root (level 0, node '') down.

    A leaf holds the records whose key's SHA-256 begins with its name of `depth` hexadecimal digits, and its digest covers them
    in order; a node's covers its children's names and digests. So no task holds more than a leaf of a 16^depth-th of
    the records, and equal manifests have equal roots, whatever the order of their rows.
    """
    record = F.to_json(F.struct(*columns))
    leaf = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, depth)
    level = files.select(leaf.alias("node"), record.alias("record")).groupBy("node").agg(F.count("*").alias("records"), F.sha2(F.array_join(F.array_sort(F.collect_list("record")), "\n"), 256).alias("sha256"))
    out, at = level.select(F.lit(depth).alias("level"), "node", "records", "sha256"), depth
    while at > 0:
        at = max(0, at - step)
        child = F.concat_ws(":", "node", "sha256")
        level = level.groupBy(F.substring("node", 1, at).alias("up")).agg(F.sum("records").alias("records"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("sha256")).withColumnRenamed("up", "node")
        out = out.unionByName(level.select(F.lit(at).alias("level"), "node", "records", "sha256"))
    return out


def file_changes(before: DataFrame, after: DataFrame, columns: list[str], key: str = "path", depth: int = 4, step: int = 2, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(rule, key, expected, observed) of the files that two manifests don't share: changed_file, missing_file, extra_file.

    The manifests' trees (`trees`, where they are stored) are compared from the root down, and only below nodes that differ;
    only the records of leaves that differ are joined. Several records of one key are compared as a whole.
    """
    one, two = trees or (manifest_tree(before, columns, key, depth, step), manifest_tree(after, columns, key, depth, step))
    one, two = cut(one, "tree"), cut(two, "tree")
    open_, at = None, 0
    while True:
        left, right = (t.where(F.col("level") == at).select("node", F.col("sha256").alias(side)) for t, side in ((one, "b"), (two, "a")))
        if open_ is not None:
            left, right = (x.withColumn("up", F.substring("node", 1, above)).join(open_, "up", "left_semi").drop("up") for x in (left, right))
        open_ = cut(left.join(right, "node", "full").where("not (b <=> a)").select(F.col("node").alias("up")), "differing")
        if at == depth or open_.isEmpty():
            break
        above, at = at, depth - ((depth - at - 1) // step) * step
    leaf = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, depth)
    own = lambda t, side: t.withColumn("up", leaf).join(open_, "up", "left_semi").groupBy(F.col(key).cast("string").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*columns)))), "\n").alias(side), F.lit(True).alias(f"in_{side}"))
    left, right = own(before, "expected").withColumnRenamed("key", "left_key"), own(after, "observed")
    both = left.join(right, F.col("left_key").eqNullSafe(F.col("key")), "full")
    rule = F.when(F.col("in_observed").isNull(), "missing_file").when(F.col("in_expected").isNull(), "extra_file").when(F.col("expected") != F.col("observed"), "changed_file")
    return both.select(rule.alias("rule"), F.coalesce("left_key", "key").alias("key"), "expected", "observed").where("rule is not null")


def select_targets(names: DataFrame, suffixes: DataFrame, pattern: str) -> DataFrame:
    """(name, suffix): names that match the pattern whole and end, after a dot, in a known suffix; the longest one.

    A name meets suffixes by equality of its dotted endings, so there is no product of names and suffixes. Of the two sides
    only suffixes are broadcast, and a name keeps the length of its longest suffix, which stands at its end.
    """
    parts = F.split("name", r"\.")
    endings = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    some = names.where(F.col("name").rlike(f"^(?:{pattern})$") & F.col("name").contains("."))
    # Without a hint Spark goes by the size of the names' file, which their endings exceed many times.
    known = sized(suffixes.select("suffix").distinct(), other="merge")
    met = some.select("name", F.explode(endings).alias("suffix")).join(known, "suffix")
    return met.groupBy("name").agg(F.max(F.length("suffix")).alias("n")).select("name", F.expr("right(name, n)").alias("suffix"))


def names_by_shard(tensors: DataFrame) -> DataFrame:
    """(shard, names): a shard's tensor names, sorted; a shard's header bounds them."""
    return tensors.groupBy("shard").agg(F.array_sort(F.collect_list("name")).alias("names"))


def placements(modules: DataFrame, device: str = "device") -> DataFrame:
    """Modules on each device."""
    return modules.groupBy(device).agg(F.count("*").alias("modules"))


def count_violations(rows: DataFrame, predicate: Column, expected: int, rule: str) -> DataFrame:
    """A violation unless so many rows fit."""
    n = rows.agg(F.count_if(predicate).alias("n"))
    return n.where(F.col("n") != expected).select(F.lit(rule).alias("rule"), F.lit("all").alias("key"), F.lit(str(expected)).alias("expected"), F.col("n").cast("string").alias("observed"))
