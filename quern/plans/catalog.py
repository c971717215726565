"""The registered queries, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.shared import bound_batches, cut
from quern.functions.text import TOKEN, bytes_label, shingled, shuffled_key, token_ids_digest
from quern.functions.vocabulary import token_counts
from quern.operators import chat, contracts, corpus, dedup, evalstats, inventory, logs, overlap, requests, selection, telemetry
from quern.operators.templates import compile_template

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of the default tokens, of words and of distinct shingles.
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::INTEGER"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_GRAMS = f"""
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) AS gram
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5)),
held AS (
  SELECT DISTINCT item_id, gram FROM (
    SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) AS gram
    FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5))"""
_MATCHES = """
sizes AS (SELECT item_id, count(*) AS heldout_grams FROM held GROUP BY item_id),
matches AS (
  SELECT c.doc_id, c.item_id, c.common, s.heldout_grams, c.common / s.heldout_grams AS containment
  FROM (SELECT g.doc_id, h.item_id, count(*) AS common FROM grams g JOIN held h ON g.gram = h.gram GROUP BY 1, 2) c
  JOIN sizes s ON c.item_id = s.item_id
  WHERE c.common >= 8 AND c.common / s.heldout_grams >= 0.5)"""


def tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", corpus.token_count(F.col("text")))


# Corpus construction


@query(f"SELECT source, count(*) AS n_rows, sum(n)::BIGINT AS tokens, min(n) AS length_min, max(n) AS length_max, avg(n) AS length_mean, sum(n) / sum(sum(n)) OVER () AS token_share FROM (SELECT source, {_TOKENS} AS n FROM documents) GROUP BY source")
def source_token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_summary(tokens(table(spark, sf_dir, "documents")), "source", "n_tokens")


@query(f"SELECT lang, count(*) AS sample_count, min(n) AS minimum, max(n) AS maximum, avg(n) AS mean, median(n) AS median, count_if(n = 2048)::BIGINT AS at_maximum FROM (SELECT lang, least({_TOKENS}, 2048) AS n FROM documents) GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n", corpus.token_count(F.col("text"), 2048))
    return corpus.length_statistics(docs, "n", 2048, ["lang"])


@query(
    f"""
WITH t AS (SELECT doc_id, source, {_TOKENS} AS n, md5('42:' || doc_id) AS k FROM documents),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE n >= 16)
SELECT source, doc_id, n AS n_tokens, coalesce(b, 0)::BIGINT AS tokens_before FROM r WHERE coalesce(b, 0) < 4000"""
)
def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(table(spark, sf_dir, "documents")).where("n_tokens >= 16").withColumn("k", shuffled_key(F.col("doc_id")))
    return corpus.budget_take(docs.select("source", "doc_id", "n_tokens", "k"), 4000, "n_tokens", [F.col("k"), F.col("doc_id")], ["source"]).select("source", "doc_id", "n_tokens", "tokens_before")


@query(
    """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
SELECT source, doc_id FROM r WHERE k <= 20"""
)
def examined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.examined(table(spark, sf_dir, "documents"), 20, "doc_id", ["source"]).select("source", "doc_id")


@query(f"SELECT source, coalesce(sum(n) FILTER (WHERE n BETWEEN 64 AND 511), 0)::BIGINT AS short, coalesce(sum(n) FILTER (WHERE n BETWEEN 1024 AND 4096), 0)::BIGINT AS long FROM (SELECT source, {_TOKENS} AS n FROM documents) GROUP BY source")
def bucket_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bucket_pivot(tokens(table(spark, sf_dir, "documents")), "source", "n_tokens", {"short": (64, 511), "long": (1024, 4096)})


@query(
    f"""
WITH t AS (SELECT source, {_TOKENS} AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS tokens, sum(n) / (SELECT sum(n) FROM t) AS share FROM t GROUP BY source)
SELECT 'insufficient_tokens' AS rule, source AS key, 25000.0::DOUBLE AS expected, tokens AS observed FROM s WHERE tokens < 25000 * 0.9
UNION ALL SELECT 'token_share', source, 0.05::DOUBLE, share FROM s WHERE abs(share - 0.05) > 0.01
UNION ALL SELECT 'total_tokens_out_of_range', 'total', 1300000.0::DOUBLE, t FROM (SELECT sum(n)::DOUBLE AS t FROM t) WHERE t NOT BETWEEN 1300000 AND 1700000"""
)
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = corpus.source_summary(tokens(table(spark, sf_dir, "documents")), "source", "n_tokens")
    goals = summary.select("source", F.lit(25000).alias("target"), F.lit(0.05).alias("share"))
    short = corpus.shortfalls(summary, goals.select("source", "target"), ["source"])
    return contracts.union(short, corpus.share_violations(summary, goals.select("source", "share"), "source", 0.01), corpus.out_of_range(summary, 1300000, 1700000))


@query(
    f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS n FROM documents),
a AS (SELECT doc_id, n FROM t ORDER BY n, doc_id LIMIT 4), b AS (SELECT doc_id, n FROM t ORDER BY n DESC, doc_id LIMIT 1)
SELECT doc_id, n AS n_tokens FROM a UNION SELECT doc_id, n FROM b"""
)
def extremes_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shortest_and_longest(tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens"), "n_tokens", "doc_id")


@query(
    """
WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS k FROM benchmark)
SELECT item_id, k <= 10 AS in_subset FROM r"""
)
def fixed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fixed_subset(table(spark, sf_dir, "benchmark"), "item_id", 10).select("item_id", "in_subset")


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)::INTEGER - 1 AS place FROM documents)
SELECT doc_id, place FROM r WHERE place < 50"""
)
def shuffled_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.frozen_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50).select("doc_id", "place")


@query("WITH n AS (SELECT greatest(1, ceil(floor(count(*) * 0.2 * 1000) / 1000))::BIGINT AS every, count(*) AS total FROM benchmark) SELECT item_id, (item_id + 1) % every = 0 OR item_id + 1 = total AS due FROM benchmark, n")
def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return corpus.due_marks(items.select("item_id", (F.col("item_id") + 1).alias("place")), "place", items.count()).select("item_id", "due")


@query("SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'licensed' ELSE 'open' END AS kind, count(*) AS n FROM (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL' END AS license FROM documents) WHERE source NOT IN ('src0', 'src1', 'src2') OR license = 'MIT' GROUP BY 1")
def licensed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("license", F.when(F.col("doc_id") % 3 == 0, "MIT").when(F.col("doc_id") % 3 == 1, "GPL"))
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "licensed").otherwise("open")
    rows = rows.withColumn("kind", kind)
    return rows.where(corpus.licensed(F.col("kind"), F.col("license"), "licensed")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'repo/' || source || ':' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id END, sha256(text)) AS identity FROM documents")
def task_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), F.col("doc_id"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", corpus.task_identity(F.concat(F.lit("repo/"), F.col("source")), [named], F.col("text")).alias("identity"))


@query("SELECT place, n.n_name AS name FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM supplier) - 1)) AS place) p JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) n ON n.i = place % (SELECT count(*) FROM nation)")
def cyclic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return corpus.repeat_cyclic(nations, table(spark, sf_dir, "supplier").count(), "n_nationkey").select("place", "name")


@query(
    f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS n FROM documents)
SELECT doc_id, list_transform(generate_series(1, n), lambda x: x::INTEGER)[1:4] AS first_ids, n AS n_mask,
  sha256(unhex(array_to_string(list_transform(generate_series(1, n), lambda x: printf('%08X', x)), ''))) AS ids_sha256 FROM t"""
)
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(table(spark, sf_dir, "documents")).withColumn("ids", F.when(F.col("n_tokens") > 0, F.sequence(F.lit(1), F.col("n_tokens"))).otherwise(F.array().cast("array<int>")))
    return rows.select("doc_id", F.slice("ids", 1, 4).alias("first_ids"), F.size(corpus.attention_mask(F.col("ids"))).alias("n_mask"), token_ids_digest(F.col("ids")).alias("ids_sha256"))


# Chat


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations WHERE text <> '' GROUP BY conv_id UNION ALL SELECT conv_id, NULL FROM conversations GROUP BY conv_id HAVING bool_and(coalesce(text, '') = '')")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.render_conversations(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS prompt, sha256(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '')) AS prompt_sha256 FROM conversations GROUP BY conv_id")
def first_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_messages(table(spark, sf_dir, "conversations")).withColumn("prompt", chat.first_prompt(F.col("messages")))
    return rows.select("conv_id", "prompt", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("SELECT conv_id, row_number AS prefix_length FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS row_number FROM conversations) WHERE role = 'assistant'")
def coherent_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_messages(table(spark, sf_dir, "conversations"))
    return chat.coherent_prefixes(rows, "messages").select("conv_id", "prefix_length")


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render_template(F.col("messages")).alias("rendered"))


@query(
    f"""
WITH t AS (SELECT conv_id, role, {_TOKENS} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system'),
p AS (SELECT conv_id, role, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS total FROM t)
SELECT conv_id, max(total)::BIGINT AS n_tokens FROM p WHERE role = 'assistant' AND total BETWEEN 32 AND 512 GROUP BY conv_id"""
)
def longest_admissible_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_messages(table(spark, sf_dir, "conversations")).withColumn("view", chat.bucket_view(F.col("messages"), F.lit("short")))
    sizes = F.transform("view", lambda m: F.regexp_count(m["content"], F.lit(TOKEN)))
    rows = rows.withColumn("sizes", sizes).withColumn("ends", chat.coherent_ends(F.col("view")))
    lengths = F.transform("ends", lambda e: F.aggregate(F.slice("sizes", 1, e), F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.withColumn("lengths", lengths).select("conv_id", corpus.longest_prefix(F.col("lengths"), 32, 512).alias("n_tokens")).where("n_tokens is not null")


#: Two templates of common kinds: marked turns with tools and calls, and bracketed turns with the system message in the first.
MARKED = """\
{%- if tools %}
    {{- '<|im_start|>system\\n' }}
    {%- if messages[0].role == 'system' %}
        {{- (messages[0].content | trim) + '\\n\\n' }}
    {%- endif %}
    {{- '# Tools\\n' }}
    {%- for tool in tools %}
        {{- tool + '\\n' }}
    {%- endfor %}
    {{- '<|im_end|>\\n' }}
{%- elif messages[0].role == 'system' %}
    {{- '<|im_start|>system\\n' + (messages[0].content | trim) + '<|im_end|>\\n' }}
{%- endif %}
{%- for message in messages %}
    {%- if message.role == 'tool' %}
        {{- '<|im_start|>user\\n<result id=' + message.tool_call_id + '>\\n' + message.content + '\\n</result><|im_end|>\\n' }}
    {%- elif not (message.role == 'system' and loop.first) %}
        {{- '<|im_start|>' + message.role + '\\n' + message.content }}
        {%- for call in message.tool_calls %}
            {%- if message.content or not loop.first %}{{- '\\n' }}{%- endif %}
            {{- '<call>' + (call.function | tojson) + '</call>' }}
        {%- endfor %}
        {{- '<|im_end|>\\n' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|im_start|>assistant\\n' }}
{%- endif %}"""
BRACKETS = """\
{{- '<s>' }}
{%- for message in messages %}
    {%- if message['role'] == 'user' %}
        {{- '[INST] ' }}
        {%- if messages[0]['role'] == 'system' and messages[0]['content'] and loop.index0 == 1 %}{{- '<<SYS>>\\n' + messages[0]['content'] + '\\n<</SYS>>\\n\\n' }}{%- endif %}
        {{- (message['content'] | trim) + ' [/INST]' }}
    {%- elif message['role'] == 'assistant' %}
        {{- ' ' + (message['content'] | trim) + '</s>' }}{{- '' if loop.last else '<s>' }}
    {%- endif %}
{%- endfor %}"""


@query(
    r"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS role1, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text1,
             regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id,
  string_agg('<|im_start|>' || role || chr(10) || CASE WHEN k = 1 AND role = 'system' THEN t ELSE coalesce(text, '') END || '<|im_end|>' || chr(10), '' ORDER BY turn) AS marked,
  '<s>' || string_agg(CASE role WHEN 'user' THEN '[INST] ' || CASE WHEN role1 = 'system' AND text1 <> '' AND k = 2 THEN '<<SYS>>' || chr(10) || text1 || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || t || ' [/INST]'
    WHEN 'assistant' THEN ' ' || t || '</s>' || CASE WHEN k = n THEN '' ELSE '<s>' END ELSE '' END, '' ORDER BY turn) AS brackets
FROM m GROUP BY conv_id"""
)
def chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_messages(table(spark, sf_dir, "conversations"))
    names = {"messages": (F.col("messages"), rows.schema["messages"].dataType)}
    return rows.select("conv_id", compile_template(MARKED, names).alias("marked"), compile_template(BRACKETS, names).alias("brackets"))


# Decontamination


@query(f"WITH {_GRAMS} SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_shingles FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id) g ON d.doc_id = g.doc_id")
def word_shingles_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.size("grams").alias("n_shingles"))


@query(f"WITH {_GRAMS}, {_MATCHES} SELECT * FROM matches")
def contamination_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(trim(b.text)) >= 40 AND contains(lower(d.text), lower(trim(b.text)))")
def contamination_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exact_containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    f"""
WITH {_GRAMS}, {_MATCHES},
exact AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(trim(b.text)) >= 40 AND contains(lower(d.text), lower(trim(b.text))))
SELECT coalesce(e.doc_id, m.doc_id) AS doc_id, coalesce(e.item_id, m.item_id) AS item_id, e.doc_id IS NOT NULL AS exact_text, m.containment
FROM exact e FULL JOIN matches m ON e.doc_id = m.doc_id AND e.item_id = m.item_id"""
)
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    f"""
WITH {_GRAMS}, {_MATCHES}
SELECT doc_id, item_id AS id, f AS field, containment FROM matches, (VALUES ('prompt'), ('code')) AS v(f) WHERE f = 'prompt' OR item_id % 2 = 0"""
)
def screened_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("code"))
    return overlap.screen_fields(table(spark, sf_dir, "documents"), cases, exact=False).select("doc_id", "id", "field", "containment")


@query("SELECT doc_id, source, lang FROM documents")
def origin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    selected = docs.select("source", F.col("doc_id").alias("source_index"))
    return overlap.origin_rows(selected, docs.select("source", F.col("doc_id").alias("source_index"), "lang")).select(F.col("source_index").alias("doc_id"), "source", "lang")


@query(f"WITH {_GRAMS}, {_MATCHES} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM matches)")
def decontaminated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = overlap.containment(docs, table(spark, sf_dir, "benchmark"))
    return overlap.exclude(docs, overlap.exclusions(found.select("doc_id")), "doc_id").select("doc_id", "source")


@query(f"WITH {_GRAMS}, {_MATCHES} SELECT source, count(*) AS n_rows, sum(n)::BIGINT AS tokens, min(n) AS length_min, max(n) AS length_max, avg(n) AS length_mean, sum(n) / sum(sum(n)) OVER () AS token_share FROM (SELECT doc_id, source, {_TOKENS} AS n FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM matches) GROUP BY source")
def decontaminated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = overlap.containment(docs, table(spark, sf_dir, "benchmark"))
    slim = tokens(docs).select("doc_id", "source", "n_tokens")
    return corpus.source_summary(overlap.exclude(slim, overlap.exclusions(found.select("doc_id")), "doc_id"), "source", "n_tokens")


@query(f"WITH {_GRAMS}, {_MATCHES} SELECT CASE WHEN count(*) > 0 THEN 'matches_need_review' ELSE 'clear' END AS status, count(*) AS unresolved_overlaps FROM matches")
def screen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return overlap.screen_status(found, "matches_need_review", "clear")


_NEEDLES = ["ereanan-the", "Tion Er", "on_the_edha", "apache license", "", "En.La"]


@query(
    """
WITH needles AS (SELECT DISTINCT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS needle FROM (SELECT unnest(['ereanan-the', 'Tion Er', 'on_the_edha', 'apache license', '', 'En.La']) AS x))
SELECT doc_id, needle FROM documents JOIN needles ON needle <> '' AND contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), needle)"""
)
def id_needle_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = spark.createDataFrame([(n,) for n in _NEEDLES], "needle string")
    return overlap.needle_matches(table(spark, sf_dir, "documents"), needles, "doc_id", "text")


@query(
    f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))) ELSE []::VARCHAR[] END AS g FROM w),
heads AS (SELECT min(doc_id) AS doc_id, g FROM sets WHERE len(g) > 0 GROUP BY g),
grams AS (SELECT doc_id, unnest(g) AS gram FROM heads),
common AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT left_id, right_id, common, common / (len(x.g) + len(y.g) - common) AS jaccard
FROM common JOIN heads x ON x.doc_id = left_id JOIN heads y ON y.doc_id = right_id
WHERE 100 * common >= 85 * (len(x.g) + len(y.g) - common)"""
)
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(dedup.shingle_classes(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query()
def neardup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_keep(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def corpus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(table(spark, sf_dir, "documents"))
    slim = cut(corpus.examined(docs.select("source", "doc_id", "n_tokens", F.sha2("text", 256).alias("identity")), 100_000, "doc_id", ["source"]), "examined")
    fit = lambda low, high: F.when(F.col("n_tokens").between(low, high), F.col("n_tokens"))
    rows = slim.select("source", "place", F.col("doc_id").alias("row_id"), "identity", fit(64, 511).alias("short_tokens"), fit(512, 2048).alias("long_tokens"))
    fitting = corpus.within_examination(docs, slim, "doc_id", "source").where("n_tokens between 64 and 2048")  # the others can't be accepted
    classes = dedup.shingle_classes(fitting, "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    rows = rows.join(classes.select("row_id", "class_id"), "row_id")
    return selection.select_corpus(rows, dedup.similar_pairs(classes, "row_id"), [selection.Budget(f"src{k}", 2000, 3000) for k in range(20)]).drop("source")


def vocabulary() -> str:
    """The vocabulary that counts tokens in `chat_corpus_selection`; every machine has it at its own place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def chat_corpus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_messages(table(spark, sf_dir, "conversations"))
    rows = rows.select("conv_id", F.concat(F.lit("src"), F.pmod("conv_id", F.lit(4)).cast("string")).alias("source"), chat.raw_messages(F.col("messages")).alias("messages"))
    path = vocabulary()
    found = selection.chat_selection(rows, [selection.Budget(f"src{k}", 4000 + 1000 * k, 12000 - 1000 * k) for k in range(4)], lambda texts: token_counts(texts, path), {"short": (128, 1024), "long": (768, 4096)})
    return found.withColumn("rendered_sha256", F.sha2("rendered", 256)).drop("rendered")


@query(
    """
WITH own AS (SELECT count(*)::VARCHAR AS d FROM documents),
reports AS (SELECT source AS name, CASE WHEN source = 'src1' THEN 'x' ELSE (SELECT d FROM own) END AS corpus_digest, CASE WHEN source = 'src2' THEN 'review' ELSE 'clear' END AS status, sum((n_chars > 20000)::INTEGER)::BIGINT AS n FROM documents GROUP BY source),
cases AS (SELECT lang AS suite, count(*) AS expected, count(DISTINCT text) AS observed FROM documents GROUP BY lang)
SELECT 'corpus_digest' AS rule, name AS key, d AS expected, corpus_digest AS observed FROM reports, own WHERE corpus_digest <> d
UNION ALL SELECT 'status', name, 'clear', status FROM reports WHERE status <> 'clear'
UNION ALL SELECT 'unresolved_overlaps', name, '0', n::VARCHAR FROM reports WHERE n > 0
UNION ALL SELECT 'suite_cases', suite, expected::VARCHAR, observed::VARCHAR FROM cases WHERE expected <> observed"""
)
def clearance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.agg(F.count("*").cast("string").alias("corpus_digest"))
    reports = docs.groupBy(F.col("source").alias("name")).agg(F.count_if(F.col("n_chars") > 20000).alias("unresolved_overlaps")).crossJoin(F.broadcast(own))  # one row
    reports = reports.withColumn("corpus_digest", F.when(F.col("name") == "src1", "x").otherwise(F.col("corpus_digest"))).withColumn("status", F.when(F.col("name") == "src2", "review").otherwise("clear")).withColumn("expected_status", F.lit("clear"))
    cases = docs.groupBy(F.col("lang").alias("suite")).agg(F.count("*").alias("expected"), F.countDistinct("text").alias("observed"))
    return overlap.clearance(own, reports, cases)


# Paired evaluation: the two labels stand for two raters of one document


def _raters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    side = lambda c, value: rows.select(F.col("lang").alias("task"), "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("doc_hash"), value.cast("double").alias("value"))
    return side("quality", F.col("quality")), side("toxic", 1 - F.col("toxic"))


@query("SELECT d.lang, count_if(quality = 1 AND toxic = 0)::BIGINT AS both_pass, count_if(quality = 1 AND toxic = 1)::BIGINT AS left_only, count_if(quality = 0 AND toxic = 0)::BIGINT AS right_only, count_if(quality = 0 AND toxic = 1)::BIGINT AS neither FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _raters(spark, sf_dir)
    pairs = left.select("task", "doc_id", F.col("value").alias("l")).join(right.select("task", "doc_id", F.col("value").alias("r")), ["task", "doc_id"])
    return evalstats.outcome_table(pairs, "l", "r", ["task"]).withColumnRenamed("task", "lang")


@query("SELECT d.lang AS task, count(*) AS documents, avg(quality - (1 - toxic)) AS mean_delta FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang")
def paired_delta_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.delta_summary(evalstats.paired_deltas(*_raters(spark, sf_dir)))


@query("SELECT avg(m) AS macro_delta, avg(m) >= -0.02 AND bool_and(m >= -0.05) AS accepted FROM (SELECT avg(quality - (1 - toxic)) AS m FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang)")
def retention_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.retention(evalstats.delta_summary(evalstats.paired_deltas(*_raters(spark, sf_dir))))


@query(
    """
WITH b AS (SELECT l.doc_id, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
l AS (SELECT lang AS task, doc_id, doc_id::VARCHAR AS h FROM b WHERE doc_id % 7 <> 0),
r AS (SELECT lang AS task, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE doc_id::VARCHAR END AS h FROM b WHERE lang <> 'es'),
f AS (SELECT coalesce(l.task, r.task) AS task, coalesce(l.doc_id, r.doc_id) AS doc_id, l.h AS lh, r.h AS rh, l.doc_id IS NOT NULL AS il, r.doc_id IS NOT NULL AS ir
      FROM (SELECT * FROM l WHERE task <> 'es') l FULL JOIN r ON l.task = r.task AND l.doc_id = r.doc_id)
SELECT 'task_strata' AS rule, 'es' AS key, 'both' AS expected, 'left only' AS observed
UNION ALL SELECT 'document_ids', task || '/' || doc_id, 'both', CASE WHEN il THEN 'left only' ELSE 'right only' END FROM f WHERE NOT (il AND ir)
UNION ALL SELECT 'document_hash', task || '/' || doc_id, lh, rh FROM f WHERE il AND ir AND lh <> rh"""
)
def pairing_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = _raters(spark, sf_dir)
    left = left.withColumn("doc_hash", F.col("doc_id").cast("string"))
    right = left.where("task <> 'es'").withColumn("doc_hash", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("doc_hash")))
    return evalstats.pairing_violations(left.where("doc_id % 7 <> 0"), right)


@query("SELECT sha256('{\"text\":' || to_json(d.text)::VARCHAR || '}') AS content_digest, quality::DOUBLE AS left_value, q2::DOUBLE AS right_value FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN (SELECT text, quality AS q2 FROM labels l2 JOIN documents d2 ON l2.doc_id = d2.doc_id) e ON e.text = d.text")
def content_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("text", F.col("quality").cast("double").alias("value"))
    return evalstats.pair_by_content(rows, rows, ["text"])


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = evalstats.paired_deltas(*_raters(spark, sf_dir)).withColumn("suite", F.lit("labels"))
    return evalstats.bootstrap(deltas, ["suite"], "task", "doc_id")


@query()
def bootstrap_ci_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = evalstats.paired_deltas(*_raters(spark, sf_dir)).withColumn("suite", F.lit("labels"))
    return evalstats.bootstrap_in_blocks(deltas, ["suite"], "task", "doc_id")


@query(
    """
WITH o AS (SELECT d.lang, count_if(quality = 1 AND toxic = 1) AS b, count_if(quality = 0 AND toxic = 0) AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang),
k AS (SELECT lang, b, c, unnest(generate_series(0, least(b, c)::BIGINT)) AS i FROM o)
SELECT lang, b::BIGINT AS left_only, c::BIGINT AS right_only, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 8) AS p_value FROM k GROUP BY lang, b, c"""
)
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paired_outcomes(spark, sf_dir)
    return found.select("lang", "left_only", "right_only", F.round(evalstats.mcnemar(F.col("left_only"), F.col("right_only")), 8).alias("p_value"))


@query("SELECT d.lang, count(*) AS n, avg((quality > 0)::INTEGER) AS accuracy FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang")
def accuracy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = _raters(spark, sf_dir)
    return evalstats.accuracy(left.withColumnRenamed("task", "lang"), "value", ["lang"])


@query("SELECT kind, count(*) AS checks, count_if(ok)::BIGINT AS passes FROM (SELECT 'quality' AS kind, quality = 1 AS ok FROM labels UNION ALL SELECT 'clean', toxic = 0 FROM labels UNION ALL SELECT 'strict', quality = 1 AND toxic = 0 FROM labels) GROUP BY kind")
def constraint_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.array(F.lit("quality"), F.lit("clean")).alias("kinds"), F.array(F.col("quality") == 1, F.col("toxic") == 0).alias("passes"))
    rows = rows.select(F.concat("kinds", F.array(F.lit("strict"))).alias("kinds"), F.concat("passes", F.array(evalstats.strict_pass(F.col("passes")))).alias("passes"))
    return evalstats.constraint_counts(rows, "kinds", "passes")


# Requests: documents stand for contexts


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "loglikelihood").otherwise("generate_until")
    rows = docs.select(F.col("lang").alias("task"), "doc_id", F.col("doc_id").alias("seq"), kind.alias("request_type"), F.concat("text", F.lit("  ")).alias("context"), F.lit("yes").alias("continuation"), F.when(F.col("doc_id") % 3 == 0, 64).alias("max_gen_toks"))
    return requests.encode_requests(rows)


_REQUESTS = r"""
r AS (SELECT lang AS task, doc_id, doc_id % 2 = 0 AS ll,
        len(regexp_extract_all(text || '  ' || CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE '' END, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::INTEGER AS n,
        CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 64 ELSE 256 END AS reserve FROM documents)"""


@query(f"WITH {_REQUESTS} SELECT task, count(DISTINCT doc_id) AS documents, max(n + reserve) AS maximum_tokens FROM r GROUP BY task")
def request_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.task_maxima(_requests(spark, sf_dir))


@query("SELECT 'document_count' AS rule, d.lang AS task, d.n AS expected, l.n AS observed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d FULL JOIN (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) l ON d.lang = l.lang WHERE d.n IS DISTINCT FROM l.n")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rated = table(spark, sf_dir, "documents"), _raters(spark, sf_dir)[0]
    expected = docs.groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("expected"))
    observed = rated.groupBy("task").agg(F.count("*").alias("observed"))
    return requests.group_count_violations(observed, expected, "task").withColumnRenamed("key", "task")


@query(f"WITH {_REQUESTS} SELECT 'truncation' AS rule, task || '/' || doc_id AS key, CASE WHEN ll THEN 1499 ELSE 1500 END AS expected, n + reserve AS observed FROM r WHERE n + reserve > CASE WHEN ll THEN 1499 ELSE 1500 END")
def request_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.truncation_violations(_requests(spark, sf_dir), 1500)


@query(f"WITH {_REQUESTS} SELECT doc_id, n AS n_tokens FROM r WHERE ll ORDER BY n DESC, doc_id LIMIT 1")
def largest_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.largest_request(_requests(spark, sf_dir)).select("doc_id", "n_tokens")


@query(
    r"""
WITH r AS (SELECT lang AS task, doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'loglikelihood' ELSE 'generate_until' END AS kind,
             text || '  ' || CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE '' END AS rendered,
             CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 64 ELSE 256 END AS reserve FROM documents),
n AS (SELECT *, len(regexp_extract_all(rendered, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS n FROM r),
d AS (SELECT task, seq, n + reserve AS total, seq // 4096 AS block, sha256(array_to_string(list_transform([task, kind, rendered, n::VARCHAR, reserve::VARCHAR], lambda x: strlen(x) || ':' || x), '')) AS digest FROM n),
b AS (SELECT task, block, count(*) AS n, max(total) AS most, sha256(string_agg(digest, '' ORDER BY seq)) AS digest FROM d GROUP BY task, block)
SELECT task, sum(n)::BIGINT AS request_count, max(most) AS maximum_tokens, sha256(string_agg(digest, '' ORDER BY block)) AS stream_sha256 FROM b GROUP BY task"""
)
def request_stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.stream_digest(_requests(spark, sf_dir), ["task"])


@query("SELECT doc_id, source, CASE WHEN doc_id % 50 = 0 THEN 'left' ELSE 'right' END AS side FROM documents WHERE doc_id % 50 IN (0, 1)")
def stream_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return requests.stream_differences(docs.where("doc_id % 50 <> 1"), docs.where("doc_id % 50 <> 0"), ["doc_id", "source"])


# Telemetry: events stand for samples, users for stages


@query("SELECT event_type, count(*) AS samples, arg_min(value, {'a': ts, 'b': event_id}) AS first_value, arg_max(value, {'a': ts, 'b': event_id}) AS last_value, min(value) AS minimum, max(value) AS maximum, arg_max(value, {'a': ts, 'b': event_id}) - arg_min(value, {'a': ts, 'b': event_id}) AS delta FROM events GROUP BY event_type")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.series_rollup(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query(
    """
WITH e AS (SELECT event_type AS stage, event_id AS seq, ts::VARCHAR AS t, floor(value * 100)::BIGINT AS v FROM events)
SELECT stage, count(*) AS samples, min(v) AS minimum_mem_available_kib, max(v) AS maximum_swap_growth_kib, [max(v), max(2 * v)] AS maximum_gpu_memory_mib,
  arg_max(v, seq) - arg_min(v, seq) AS psi_delta_some_usec, 4096 * (arg_max(v, seq) - arg_min(v, seq)) AS swap_in_delta_bytes FROM e GROUP BY stage"""
)
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("value") * 100)
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), v.alias("v"))
    rows = rows.select("ts", "stage", "seq", *[F.col("v").alias(k) for k in ("mem_kib", "swap_growth_kib", "rss_kib", "vmswap_kib", "disk_bytes", "psi_some", "psi_full", "pswpin", "pswpout")], F.concat_ws(",", "v", 2 * F.col("v")).alias("gpus"))
    return telemetry.stage_rollup(rows).select("stage", "samples", "minimum_mem_available_kib", "maximum_swap_growth_kib", "maximum_gpu_memory_mib", "psi_delta_some_usec", "swap_in_delta_bytes")


_ISLANDS = "SELECT *, (sum((NOT breach)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS island FROM (SELECT *, coalesce(value > 20, false) AS breach FROM events)"


@query(f"SELECT user_id, island, count(*) AS samples FROM ({_ISLANDS}) WHERE breach GROUP BY 1, 2 HAVING count(*) >= 5")
def consecutive_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.consecutive_breaches(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 20)


@query(
    f"""
WITH b AS (SELECT *, min(ts) OVER (PARTITION BY user_id, island) AS started FROM ({_ISLANDS}) WHERE breach)
SELECT user_id, island, min(started) AS started, min(ts) AS raised_at,
  arg_min(CASE WHEN value > 60 THEN 'over_20+over_60' ELSE 'over_20' END, {{'a': ts, 'b': event_id}}) AS reasons
FROM b WHERE epoch(ts) - epoch(started) >= 86400 GROUP BY user_id, island"""
)
def sustained_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.sustained_breaches(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], {"over_20": F.col("value") > 20, "over_60": F.col("value") > 60}, 86400)


@query("SELECT event_type, count(value) AS count, median(value) AS median, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, stddev_pop(value) AS population_standard_deviation FROM events GROUP BY event_type")
def bench_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.distribution(table(spark, sf_dir, "events"), "value", ["event_type"])


@query(
    """
WITH e AS (SELECT user_id AS request_id, epoch_us(ts) / 1e6 AS ts, min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) - 1 AS started, event_type, value FROM events),
g AS (SELECT request_id, min(started) AS s, max(ts) AS f, min(ts) FILTER (WHERE event_type <> 'click') AS t, arg_max(floor(value * 10)::BIGINT, ts) AS p, arg_max(floor(value * 100)::BIGINT, ts) AS c FROM e GROUP BY request_id)
SELECT request_id, round(t - s, 5) AS ttft, round(f - s, 5) AS total, p AS prompt_tokens, c AS completion_tokens, round(greatest(c - 1, 0) / greatest(f - t, 1e-9), 9) AS decode FROM g WHERE t IS NOT NULL"""
)
def stream_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type", "value")
    first = F.min("ts").over(Window.partitionBy("request_id"))
    chunks = e.withColumn("started", first - 1).withColumn("text", F.when(F.col("event_type") != "click", "x")).withColumn("prompt_tokens", F.floor(F.col("value") * 10)).withColumn("completion_tokens", F.floor(F.col("value") * 100))
    spoken = chunks.groupBy("request_id").agg(F.max("text").alias("any")).where("any is not null").select("request_id")
    t = telemetry.stream_timings(chunks.join(spoken, "request_id"))
    return t.select("request_id", F.round("time_to_first_token_seconds", 5).alias("ttft"), F.round("total_seconds", 5).alias("total"), "prompt_tokens", "completion_tokens", F.round("decode_tokens_per_second", 9).alias("decode"))


# Inventories, logs and contracts: inline rows


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    module = F.element_at(F.array(*map(F.lit, ("mlp.up_proj", "self_attn.q_proj", "input_layernorm", "linear_attn.conv1d"))), (k % 4 + 1).cast("int"))
    one = F.lit(1).cast("long")
    shape = F.when(k % 4 == 0, F.array(64 * size, 32 * one)).when(k % 4 == 1, F.array(32 * one, size)).when(k % 4 == 2, F.array(size)).otherwise(F.array(size, one, 4 * one))
    dtype = F.when(F.col("p_brand") == "Brand#13", "F32").when(F.col("p_brand") == "Brand#5", "XX").otherwise("BF16")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("model.layers."), F.floor(k / 4).cast("string"), F.lit("."), module, F.lit(".weight")).alias("name"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("shard"), dtype.alias("dtype"), shape.alias("shape"), (1000 * k).cast("long").alias("start"), k.alias("k"), "p_size")
    return rows.withColumn("end", F.col("start") + inventory.elements(F.col("shape")) * F.when(F.col("dtype") == "F32", 4).otherwise(2) + F.when(F.col("k") % 100 == 7, 2).otherwise(0))


_TENSORS = """
t AS (
  SELECT *, 'model.layers.' || k // 4 || '.' || module || '.weight' AS name, n * width + CASE WHEN k % 100 = 7 THEN 2 ELSE 0 END AS bytes FROM (
    SELECT p_partkey AS k, p_size, 's' || p_partkey % 3 AS shard,
           (['mlp.up_proj', 'self_attn.q_proj', 'input_layernorm', 'linear_attn.conv1d'])[p_partkey % 4 + 1] AS module,
           p_size::BIGINT * ([2048, 32, 1, 4])[p_partkey % 4 + 1] AS n,
           CASE p_brand WHEN 'Brand#13' THEN 'F32' WHEN 'Brand#5' THEN 'XX' ELSE 'BF16' END AS dtype, CASE p_brand WHEN 'Brand#13' THEN 4 ELSE 2 END AS width FROM part))"""


@query(
    f"""
WITH {_TENSORS},
l AS (SELECT dtype, bytes, CASE module WHEN 'input_layernorm' THEN 'Normalization' WHEN 'linear_attn.conv1d' THEN 'Depthwise Conv1d' ELSE 'Linear' END AS kind,
        CASE module WHEN 'mlp.up_proj' THEN 'text_mlp' WHEN 'self_attn.q_proj' THEN 'full_attention' WHEN 'input_layernorm' THEN 'normalization' ELSE 'recurrent_gdn' END AS component FROM t)
SELECT 'dtype' AS "grouping", dtype AS label, count(*) AS tensors, sum(bytes)::BIGINT AS bytes FROM l GROUP BY dtype
UNION ALL SELECT 'kind', kind, count(*), sum(bytes)::BIGINT FROM l GROUP BY kind UNION ALL SELECT 'component', component, count(*), sum(bytes)::BIGINT FROM l GROUP BY component"""
)
def tensor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.tensor_rollup(_tensors(spark, sf_dir))


@query(
    f"""
WITH {_TENSORS}
SELECT 'missing_tensor' AS rule, 'gone.' || k AS key, 's9' AS expected, NULL AS observed FROM t WHERE p_size = 4
UNION ALL SELECT 'unindexed_tensor', name, NULL, shard FROM t WHERE p_size = 2
UNION ALL SELECT 'mapping_mismatch', name, 's9', shard FROM t WHERE p_size = 3
UNION ALL SELECT 'duplicate_tensor', name, '1', '2' FROM t WHERE p_size = 1"""
)
def inventory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _tensors(spark, sf_dir)
    index = there.where("p_size <> 2").select("name", F.when(F.col("p_size") == 3, "s9").otherwise(F.col("shard")).alias("shard"))
    gone = there.where("p_size = 4").select(F.concat(F.lit("gone."), F.col("k").cast("string")).alias("name"), F.lit("s9").alias("shard"))
    return inventory.reconcile(index.unionByName(gone), there.unionByName(there.where("p_size = 1")))


@query(f"WITH {_TENSORS} SELECT 'tensor_bytes' AS rule, name AS key, (n * width)::VARCHAR AS expected, bytes::VARCHAR AS observed FROM t WHERE dtype <> 'XX' AND k % 100 = 7")
def tensor_byte_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.byte_violations(_tensors(spark, sf_dir))


@query(f"WITH {_TENSORS} SELECT 'model.layers.' || k // 4 || '.mlp.up_proj' AS name, 'mlp.up_proj' AS suffix FROM t WHERE k % 4 = 0")
def selected_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _tensors(spark, sf_dir).select(F.regexp_replace("name", r"\.weight$", "").alias("name"))
    suffixes = spark.createDataFrame([("up_proj",), ("mlp.up_proj",), ("fc",)], "suffix string")
    return inventory.select_targets(names, suffixes, r"model\.layers\.\d+\..+")


@query(f"WITH {_TENSORS} SELECT shard, count(*) AS n FROM t GROUP BY shard")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.names_by_shard(_tensors(spark, sf_dir)).select("shard", F.size("names").cast("long").alias("n"))


@query(
    f"""
WITH {_TENSORS}
SELECT pattern, n AS n_matched, n = 0 AND pattern NOT LIKE 're:^mtp%' AS unresolved FROM (
  SELECT 'model.layers.0.mlp.up_proj.weight' AS pattern, count_if(k = 0)::BIGINT AS n FROM t UNION ALL SELECT 're:.*layernorm.*', count_if(k % 4 = 2)::BIGINT FROM t
  UNION ALL SELECT 'up_proj.weight', count_if(k % 4 = 0)::BIGINT FROM t UNION ALL SELECT 're:^mtp.x', 0 UNION ALL SELECT 'none', 0)"""
)
def policy_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.resolve_policy(_tensors(spark, sf_dir), ["model.layers.0.mlp.up_proj.weight", "re:.*layernorm.*", "up_proj.weight", "re:^mtp.x", "none"])[1]


@query(f"WITH {_TENSORS}, w AS (SELECT sum(n)::BIGINT AS w FROM t WHERE k % 4 = 0) SELECT w AS weights, (w + 1) // 2 AS packed_bytes, (w + 127) // 128 * 2 AS scale_bytes, 1000000000 - 2 * w + (w + 1) // 2 + (w + 127) // 128 * 2 AS checkpoint_bytes FROM w")
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.storage_estimate(_tensors(spark, sf_dir).where("contains(name, 'up_proj')"), 1_000_000_000)


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024) ELSE printf('%.2f MiB', n / 1048576) END AS size FROM (SELECT doc_id, n_chars * 997.0::DOUBLE / 3 AS n FROM documents)")
def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bytes_label(F.col("n_chars") * 997.0 / 3).alias("size"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    head = F.when(kind == "error", F.concat(F.lit("ERROR of user "), F.col("user_id").cast("string"), F.lit(": an exception\n"))).when(kind == "signup", "WARNING: OOM seen\nleft truncated\n").when(kind == "purchase", "prompt exceeds model's max length\n").otherwise("Traceback (benign)\n")
    text = F.concat(head, F.lit(f"{logs.MARKERS['native_kernel_not_observed']}\n"), F.when(kind == "view", "-").otherwise("running in text-only mode."), F.lit("\nChunked prefill is enabled with max_num_batched_tokens=2,048.\nGPU KV cache size: "), F.format_number(F.floor(F.col("value") * 200), 0), F.lit(" tokens"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("log"))


_FAILURES = "CASE event_type WHEN 'error' THEN 'runtime_exception_detected' WHEN 'signup' THEN 'allocator_oom_warning_detected' WHEN 'purchase' THEN 'runtime_truncation_detected' END"


@query(f"SELECT event_id, {_FAILURES} AS failure FROM events")
def log_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select("event_id", logs.failure_class(F.col("log")).alias("failure"))


@query(
    f"""
WITH l AS (SELECT event_id::VARCHAR AS key, event_type, {_FAILURES} AS failure, floor(value * 200)::BIGINT AS capacity FROM events)
SELECT failure AS rule, key, NULL AS expected, NULL AS observed FROM l WHERE failure IS NOT NULL
UNION ALL SELECT 'text_only_not_observed', key, 'running in text-only mode.', NULL FROM l WHERE event_type = 'view'
UNION ALL SELECT 'kv_capacity', key, '20992', capacity::VARCHAR FROM l WHERE capacity < 20992"""
)
def log_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_violations(_logs(spark, sf_dir), "event_id", "log", 2048, 20992)


@query("SELECT 'split_count' AS rule, 'corpus/' || lang || '/train' AS key, n::VARCHAR AS expected, (n + 1)::VARCHAR AS observed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) WHERE lang = 'fr' UNION ALL SELECT 'split_count', 'corpus/xx/train', '5', NULL")
def pinned_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("variant")).agg(F.count("*").alias("n_rows")).select(F.lit("corpus").alias("dataset"), "variant", F.lit("train").alias("split"), "n_rows")
    other = spark.createDataFrame([("corpus", "xx", "train", 5)], seen.schema)
    observed = seen.withColumn("n_rows", F.col("n_rows") + (F.col("variant") == "fr").cast("long"))
    return contracts.split_count_violations(seen.unionByName(other), observed)


@query("SELECT 'source' AS rule, 'src' || k AS key, CASE WHEN k = 3 THEN 'present' ELSE 'absent' END AS expected, CASE WHEN k = 3 THEN 'missing' ELSE 'extra' END AS observed FROM (VALUES (3), (5)) AS v(k)")
def source_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("source")
    return contracts.set_violations(sources.where("source <> 'src5'"), sources.where("source <> 'src3'"), "source", "source")


@query("""
WITH f AS (SELECT '{"path":' || doc_id || ',"size_bytes":' || length(text) || '}' AS record, length(text) AS n FROM documents)
SELECT count(*) AS file_count, sum(n)::BIGINT AS size_bytes, sha256(string_agg(record, chr(10) ORDER BY record)) AS identity_sha256 FROM f""")
def manifest_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.length("text").cast("long").alias("size_bytes"))
    return inventory.order_free_identity(files, ["path", "size_bytes"])


@query("""
WITH f AS (SELECT '{"path":"' || doc_id || '","size_bytes":' || length(text) || '}' AS record, substr(sha256(doc_id::VARCHAR), 1, 2) AS node FROM documents),
l2 AS (SELECT node, count(*) AS records, sha256(string_agg(record, chr(10) ORDER BY record)) AS sha256 FROM f GROUP BY node),
l1 AS (SELECT substr(node, 1, 1) AS node, sum(records)::BIGINT AS records, sha256(string_agg(node || ':' || sha256, chr(10) ORDER BY node)) AS sha256 FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS node, sum(records)::BIGINT AS records, sha256(string_agg(node || ':' || sha256, chr(10) ORDER BY node)) AS sha256 FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""")
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("size_bytes"))
    return inventory.manifest_tree(files, ["path", "size_bytes"], depth=2, step=1)


@query("""
WITH b AS (SELECT doc_id, '{"path":"' || doc_id || '","size_bytes":' || length(text) || '}' AS r FROM documents WHERE lang <> 'fr'),
a AS (SELECT doc_id, '{"path":"' || doc_id || '","size_bytes":' || length(regexp_replace(text, '[|$%&#*]', '', 'g')) || '}' AS r FROM documents WHERE lang <> 'de')
SELECT CASE WHEN a.r IS NULL THEN 'missing_file' WHEN b.r IS NULL THEN 'extra_file' ELSE 'changed_file' END AS rule, coalesce(b.doc_id, a.doc_id)::VARCHAR AS key, b.r AS expected, a.r AS observed
FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.r IS DISTINCT FROM a.r""")
def manifest_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "lang")
    before = docs.where("lang <> 'fr'").select("path", F.length("text").cast("long").alias("size_bytes"))
    after = docs.where("lang <> 'de'").select("path", F.length(F.regexp_replace("text", "[|$%&#*]", "")).cast("long").alias("size_bytes"))
    return inventory.file_changes(before, after, ["path", "size_bytes"])
