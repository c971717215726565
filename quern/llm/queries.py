"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.shared import BATCH_ROWS as BATCH_ROWS
from quern.functions.shared import bound_batches, new_path
from quern.llm.collocations import collocations
from quern.llm.conversation_repair import damage, repair_conversations
from quern.llm.exact_search import search_exact
from quern.llm.html_text import extract_text
from quern.llm.language_id import fit_languages, predict_languages
from quern.llm.lattice_dedup import link_vectors
from quern.llm.mixing import mix_sources
from quern.llm.ngram_join import ngram_components
from quern.llm.ordinal import fit_ordinal, grades_of, score_ordinal
from quern.llm.packing import pack_documents
from quern.llm.suffix_dedup import remove_repeats
from quern.llm.url_filters import judge_urls
from quern.llm.warc import assemble, captured_pages, read_records, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_ordinal(docs, grades_of(_table(spark, sf_dir, "labels")), grades=3)
    return score_ordinal(docs, model, select=2)


@_query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("""
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
               ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS rules(host, path, verdict)""")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


ORACLES["op2_url_filters"] = """
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT p.page_id, max({'n': length(r.host) + length(r.path), 'h': length(r.host), 'v': r.verdict, 'r': r.host || r.path}) AS best
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.best['r'] AS rule, coalesce(f.best['v'], 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""


@_query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


@_query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return captured_pages(assemble(read_records(spark, path, with_payload=False))).drop("url")


def vocabulary() -> str:
    """The vocabulary file of the packing query; every machine has it at its own place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), with_ids=False).drop("ids", "loss_tokens")


@_query
def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mixing_sources"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, length(text) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / (CASE WHEN size >= 20 AND chars BETWEEN size * 3 AND size * 10 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS k FROM sized),
sums AS (SELECT s, sum(size)::BIGINT AS source_size FROM keyed GROUP BY s),
weighted AS (
  SELECT *, source_size * 2 AS cap, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM sums),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER ())::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
         sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM weighted WINDOW o AS (ORDER BY cap / w, s)),
first_open AS (SELECT place, rest, shares FROM levels WHERE rest * w / shares < cap ORDER BY place LIMIT 1),
targets AS (
  SELECT l.s, l.source_size,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN l.cap::DOUBLE ELSE f.rest * l.w / f.shares END AS target
  FROM levels l LEFT JOIN first_open f ON true),
summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.s ORDER BY k.k, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.s = t.s)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN before < target - epochs * source_size AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""


@_query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


@_query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_exact(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op10_exact_topk"] = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i+1], ' '))) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' '))) FROM pieces),
counts AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, i, array_to_string(c.w[:i], ' ') AS head, array_to_string(c.w[i+1:], ' ') AS tail
  FROM counts c, (VALUES (1), (2)) AS places(i) WHERE i < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score, i
  FROM cuts c JOIN counts h ON c.lang = h.lang AND c.head = h.phrase JOIN counts t ON c.lang = t.lang AND c.tail = t.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
covered AS (
  SELECT lang, phrase, max(f) AS above FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM counts WHERE k = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT l.lang, l.phrase, l.a, l.l, l.r, l.score,
         row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN covered c ON l.lang = c.lang AND l.phrase = c.phrase AND l.k = 2
  WHERE c.above IS NULL OR 100 * c.above < 50 * l.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""


@_query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict_languages(docs, fit_languages(docs.where(~held_out)), keep={"held_out": held_out})


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(_table(spark, sf_dir, "conversations")), lost="lost")
