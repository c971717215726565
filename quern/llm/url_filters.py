"""URL rules by a sort-merge range join: one sweep over reversed hosts, with a stack of nested rules.

A host's canonical key is its labels in reverse order, each followed by a full stop, so that a
rule's host covers exactly the keys that begin with its own: an interval of the sorted keys. Such
intervals nest or are apart. When a rule's interval opens, the stack of rules then open is known:
it is the rule's own chain of enclosing rules. So the sweep is a window over rules and URLs
sorted by key that carries on the last opened stack; of that stack, the entries whose interval
still holds the URL's key are the active rules, and every active rule is among them.

Only DataFrame functions are used. The sweep runs in `SHARDS * SALTS` groups: by the last two labels
of a host and, as one domain may hold most URLs, by a hash of the URL. A rule is copied to the salts of
its shard, a rule of one label to all groups; the number of copies doesn't grow with the URLs.

A rule (host, path, verdict) fits a URL whose host is the rule's or below it and whose path starts with
the rule's. The longest rule string wins, then the longer host, then `block`.

Nulls and oddities: the host is what stands between the first `://` and the next `/`, `?`, `#` or
the end, with A-Z lower-cased; the path goes on to `?`, `#` or the end. A null URL or one without
`://` has both empty, and the default verdict. Repeated rows stay, each judged; repeated rules
count once. Rules with null fields are left out. Without rules all URLs get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SALTS = 64, 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, _UPPER, _UPPER.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _shard(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.pmod(F.xxhash64(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")), F.lit(SHARDS))


def _stacks(rules: DataFrame) -> DataFrame:
    """(host, key, chain): the stack when each rule host's interval opens, its own rules included."""
    hosts = rules.groupBy("host").agg(F.collect_list(F.struct(_key(F.col("host")).alias("key"), "host", "path", "verdict")).alias("own"))
    above = hosts.select(F.col("host").alias("opened"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda k: F.array_join(F.slice(F.split("host", r"\."), k, F.size(F.split("host", r"\."))), "."))).alias("host"))
    chains = above.join(hosts, "host").groupBy("opened").agg(F.flatten(F.collect_list("own")).alias("chain"))
    return chains.select(F.col("opened").alias("host"), _key(F.col("opened")).alias("key"), "chain")


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of `urls`: id, host, path, rule, verdict. `rules`: host, path, verdict."""
    host, path = split_url(F.col("url"))
    seen = urls.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    seen = seen.select(_shard(F.col("host")).alias("shard"), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).alias("salt"), _key(F.col("host")).alias("key"), F.lit(1).alias("turn"), "id", "host", "path", F.lit(None).cast("array<struct<key:string,host:string,path:string,verdict:string>>").alias("chain"))
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna().distinct()
    opened = _stacks(rules)
    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(SHARDS - 1).cast("long"))
    opened = opened.withColumn("shard", F.explode(F.when(F.instr("host", ".") == 0, everywhere).otherwise(F.array(_shard(F.col("host"))))))
    opened = opened.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    opened = opened.select("shard", "salt", "key", F.lit(0).alias("turn"), F.lit(None).cast(urls.schema[id].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "chain")
    sweep = Window.partitionBy("shard", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = seen.unionByName(opened).withColumn("stack", F.last("chain", ignorenulls=True).over(sweep)).where("turn = 1")
    active = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(active, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("length"), F.length(r["host"]).alias("of_host"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    swept = swept.withColumn("best", best)
    return swept.select(F.col("id").alias(id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
