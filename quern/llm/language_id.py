"""Language identification by mixture inference: expectation-maximisation over n-gram likelihoods, sets by penalised likelihood.

A text's letters, lower-cased, with one blank for each gap between words and at both ends, give its runs of three bytes,
hashed to 2^BITS buckets. Each language has a distribution over buckets, smoothed by that of all languages together. A
document is a mixture: each n-gram comes from one of its languages, and expectation-maximisation estimates the
languages' shares. The value of a set is its log likelihood less `price` * log(1 + n-grams) for each language after the first;
as n-grams overlap, each counts a third. Sets are nested: first the likeliest single language, then the others by their
shares in the mixture of all. A set grows while its value does, with its shares estimated anew; where even the mixture of
all gains less than one language's price, none is added. The prediction is the largest share of the set; the score is that
share, or, where the set is one language, its posterior among single languages.

Training takes the texts of at most `most_texts` documents of each language, those of the least hash of their id, text
and language, so the sample is bounded, the same in each run, and drawn from all. Counts
are summed by Spark; the driver gets and sends one table of languages x 2^BITS floats (0.5 MB a language).
Prediction is one pass over whole texts without a shuffle, in blocks of documents, each a bounded number of n-grams.

Nulls and oddities: a text that is null or has no letter is `und` with score 0 and teaches nothing. Without any training
text everything is `und`. Equal likelihoods go to the first language by bytes. A language that few texts have is as
good as their letters allow. Repeated rows are predicted each. A very long text is read whole, in parts of a few
MB whose counts are added. An empty table gives an empty result. Columns other than those named are ignored, and
the language, source and id of a document are never read by its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.batches import pieces
from quern.functions.textvec import loads8, mix, text_bytes

BITS, SIZE = 16, 3
#: N-grams of all documents of a block times languages, at most about so many.
_BLOCK = 4 << 20
_PART = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of bytes, log probabilities (languages, buckets), and the log of each language's share of training texts."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray


def letters(text: Column) -> Column:
    """Lower case, a blank for each gap between letters, and one before the first and after the last; empty without letters."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " "))
    return F.when(bare.rlike(r"\p{L}"), F.concat(F.lit(" "), bare, F.lit(" "))).otherwise(F.lit(""))


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the n-grams of each prepared text, in the order of text and bucket."""
    data, offsets = text_bytes(column)
    keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    doc, wide = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.uint64((1 << (8 * SIZE)) - 1)
    for at in range(0, len(data), _PART):
        part = data[at : at + _PART + SIZE - 1]
        n = max(0, len(part) - SIZE + 1)
        own = doc[at : at + n]
        fine = own == doc[at + SIZE - 1 : at + SIZE - 1 + n]
        bucket = (mix(loads8(part)[:n][fine] & wide) >> np.uint64(64 - BITS)).astype(np.int64)
        key, number = np.unique((own[fine] << BITS) | bucket, return_counts=True)
        keys.append(key)
        numbers.append(number)
    key, number = np.concatenate(keys), np.concatenate(numbers)
    if len(keys) > 2:  # a text may stand in two parts
        key, place = np.unique(key, return_inverse=True)
        number = np.bincount(place, number).astype(np.int64)
    return key >> BITS, key & ((1 << BITS) - 1), number


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", _PART):
            text, bucket, number = grams(part.column("text"))
            names, lang = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            key, place = np.unique((lang[text] << BITS) | bucket, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names[key >> BITS].tolist(), pa.string()), "bucket": pa.array((key & ((1 << BITS) - 1)).astype(np.int32)), "n": pa.array(np.bincount(place, number).astype(np.int64))})


def sample_of(docs: DataFrame, most_texts: int, id: str, text: str, lang: str) -> tuple[DataFrame, dict[str, int]]:
    """((lang, text): prepared texts of at most `most_texts` documents of each language; the number of texts of each).

    A first cut by the hash of id, text and language leaves about four times as many of each language, so ranking takes a
    bounded task for each; rows alike in all three count once.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text), F.col(lang)).alias("key"))
    texts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, 4 * most_texts / n)) for x, n in texts.items()], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where((F.col("key") / F.lit(2.0**64) + 0.5) < F.col("share")).drop("share")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = near.select("lang", "key").distinct().withColumn("place", place).where(F.col("place") <= most_texts).groupBy("lang").agg(F.max("key").alias("limit"))
    kept = near.join(F.broadcast(chosen), "lang").where("key <= limit").dropDuplicates(["lang", "key"])
    return kept.select("lang", letters(F.col("text")).alias("text")), texts


def fit_languages(docs: DataFrame, most_texts: int = 1000, smooth: float = 200.0, id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on the rows of `docs` whose `lang` isn't null."""
    sample, texts = sample_of(docs, most_texts, id, text, lang)
    counts = sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()), key=str.encode)
    table = np.zeros((1 << BITS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    table[counts.column("bucket").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    shared = table.sum(1) + 0.5
    shared /= shared.sum()
    logs = np.log((table + smooth * shared[:, None]) / (table.sum(0) + smooth))
    share = np.array([texts[x] for x in languages], float)
    return LanguageModel(languages, np.ascontiguousarray(logs.T, np.float32), np.log(share / share.sum()) if len(share) else share)


def mixtures(likely: np.ndarray, count: np.ndarray, cuts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (languages, documents) and log likelihoods by expectation-maximisation from equal shares.

    `likely` (languages, n-grams) holds the n-grams' probabilities, scaled for each n-gram; those of document i are
    cuts[i]:cuts[i + 1], one at least.
    """
    size = np.diff(cuts)
    doc, begin = np.repeat(np.arange(len(size)), size), cuts[:-1]
    total = np.add.reduceat(count, begin)
    shares = np.full((len(likely), len(size)), 1 / len(likely), np.float32)
    for _ in range(rounds):
        given = likely * shares[:, doc]
        given *= count / given.sum(0)
        shares = np.add.reduceat(given, begin, axis=1) / total
    return shares, np.add.reduceat(count * np.log((likely * shares[:, doc]).sum(0)), begin)


def infer(model: LanguageModel, bucket: np.ndarray, count: np.ndarray, cuts: np.ndarray, price: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, posterior), languages by documents: shares over the chosen set, 0 elsewhere, and the posterior of single languages."""
    docs, width = len(cuts) - 1, len(model.languages)
    logs = model.logs[:, bucket]
    logs = logs - logs.max(0)
    likely, count = np.maximum(np.exp(logs), np.float32(1e-12)), (count / SIZE).astype(np.float32)
    single = np.add.reduceat((logs * count).astype(np.float64), cuts[:-1], axis=1)
    posterior = single + model.prior[:, None]
    posterior = np.exp(posterior - posterior.max(0))
    posterior /= posterior.sum(0)
    rows, cost = np.arange(docs), price * np.log1p(np.add.reduceat(count, cuts[:-1]))
    first = (single + model.prior[:, None]).argmax(0)
    shares = np.zeros((width, docs))
    shares[first, rows] = 1
    if width == 1:
        return shares, posterior
    value = single[first, rows]
    full, most = mixtures(likely, count, cuts, rounds)
    full[first, rows] = 2
    order, some = np.argsort(-full, axis=0, kind="stable"), np.flatnonzero(most - cost > value)
    for k in range(2, width + 1):
        if not len(some):
            break
        size = np.diff(cuts)[some]
        own = np.r_[0, np.cumsum(size)]
        picked = np.repeat(cuts[some] - own[:-1], size) + np.arange(own[-1])
        found, logs_ = mixtures(likely[np.repeat(order[:k, some], size, axis=1), picked], count[picked], own, rounds)
        gain = logs_ - (k - 1) * cost[some]
        better = gain > value[some]
        some = some[better]
        value[some] = gain[better]
        shares[order[:k, some], some] = found[:, better]
    return shares, posterior


def _predict(model: LanguageModel, price: float, rounds: int, with_shares: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.languages)
        for batch in batches:
            for part in pieces(batch, "text", _PART):
                lang, score = np.array(["und"] * len(part), dtype=object), np.zeros(len(part))
                found: list[dict | None] = [None] * len(part)
                if width:
                    text, bucket, number = grams(part.column("text"))
                    owner, cuts = np.unique(text, return_index=True)
                    cuts = np.r_[cuts, len(text)]
                    at = 0
                    while at < len(owner):
                        to = int(np.searchsorted(cuts, cuts[at] + max(1, _BLOCK // width), side="right")) - 1
                        to = min(max(to, at + 1), len(owner))
                        span = slice(cuts[at], cuts[to])
                        shares, posterior = infer(model, bucket[span], number[span], cuts[at : to + 1] - cuts[at], price, rounds)
                        first, rows = shares.argmax(0), np.arange(to - at)
                        lang[owner[at:to]] = np.array(model.languages, dtype=object)[first]
                        score[owner[at:to]] = np.clip(np.where((shares > 0).sum(0) == 1, posterior[first, rows], shares[first, rows]), 0, 1)
                        if with_shares:
                            for i, row in zip(owner[at:to].tolist(), shares.T.tolist(), strict=True):
                                found[i] = {x: s for x, s in zip(model.languages, row, strict=True) if s > 0}
                        at = to
                columns = {k: part.column(k) for k in part.schema.names if k != "text"} | {"lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score)}
                if with_shares:
                    columns["shares"] = pa.array([None if x is None else list(x.items()) for x in found], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, price: float = 4.0, rounds: int = 10, id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, with_shares: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, the columns `keep`, lang_pred and score; `with_shares` adds a map of the chosen set's shares."""
    rows = docs.select(letters(F.col(text)).alias("text"), F.col(id).alias("id"), *(c.alias(f"keep_{k}") for k, c in (keep or {}).items()))
    schema = StructType([*rows.schema.fields[1:], *StructType.fromDDL("lang_pred string, score double" + (", shares map<string, double>" if with_shares else ""))])
    found = rows.mapInArrow(_predict(model, price, rounds, with_shares), schema)
    return found.select(F.col("id").alias(id), *(F.col(f"keep_{k}").alias(k) for k in keep or {}), "lang_pred", "score", *(["shares"] if with_shares else []))
