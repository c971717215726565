"""Language identification: held-out accuracy, mixtures, and expectation-maximisation against a plain version."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id as li
from quern.llm import queries

SF = "/root/testdata/sf0.01"
EN = "the quick brown fox jumps over the lazy dog while all the other animals watch from the edge of the wood and think about it "
DE = "der schnelle braune Fuchs springt über den faulen Hund und die anderen Tiere sehen vom Rand des Waldes aus zu und denken nach "
RU = "быстрая коричневая лиса прыгает через ленивую собаку пока остальные звери смотрят с опушки леса и думают об этом "


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    words = {"en": EN.split(), "de": DE.split(), "ru": RU.split()}
    rng = np.random.default_rng(1)
    rows = [(100 * k + i, " ".join(rng.choice(w, 30)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(40)]
    return li.fit_languages(docs_of(spark, rows + [(9999, None, "fr"), (9998, "123 !?", "es"), (9997, EN, None)]))


def test_fit_and_predict(spark, model):
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, EN.upper(), "x"), (2, DE, None), (3, RU, None), (4, None, "en"), (5, "", "en"), (6, "12 %% \n", "en"), (7, "der", None), (None, "dog", None), (8, DE * 3 + EN * 3, None), (9, (DE * 4000) + (RU * 8000), None), (2, DE, None)]
    got = li.predict_languages(docs_of(spark, rows).withColumn("score", F.lit("x")), model, with_shares=True, keep={"lang_pred_": F.col("lang")}).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got][:8] == [(1, "en"), (2, "de"), (3, "ru"), (4, "und"), (5, "und"), (6, "und"), (7, "de"), (None, "en")]
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert set(got[0]["shares"]) == {"en"} and set(got[8]["shares"]) == {"de", "en"} and abs(got[8]["shares"]["de"] - 0.5) < 0.1
    assert set(got[9]["shares"]) == {"de", "ru"} and got[9]["lang_pred"] == "ru" and got[10] == got[1]
    nothing = li.fit_languages(docs_of(spark, rows).where("lang = 'none'"))
    assert {r["lang_pred"] for r in li.predict_languages(docs_of(spark, rows), nothing).collect()} == {"und"}
    assert li.predict_languages(docs_of(spark, rows).limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    rows = [(i, EN if i < 80 else DE, "en" if i < 80 else "de") for i in range(100)] + [(1, EN, "en")] * 50
    sample, texts = li.sample_of(docs_of(spark, rows), 30, "doc_id", "text", "lang")
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 30, "de": 20} and texts == {"en": 130, "de": 20}
    many = spark.range(20_000).selectExpr("id AS doc_id", "'ein text' AS text", "if(id % 10 = 0, 'xx', 'de') AS lang")
    sample, _ = li.sample_of(many, 100, "doc_id", "text", "lang")
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"xx": 100, "de": 100}


def plain_grams(text):
    found = {}
    data = text.encode()
    for i in range(len(data) - 2):
        x = np.array([int.from_bytes(data[i : i + 3], "little")], np.uint64)
        b = int(li.mix(x)[0] >> np.uint64(64 - li.BITS))
        found[b] = found.get(b, 0) + 1
    return found


def test_grams(monkeypatch):
    texts = [" a ", "", " der hund der ", " über ", "", " abcdef ghij "]
    for part in (1 << 20, 5):
        monkeypatch.setattr(li, "_PART", part)
        text, bucket, number = li.grams(pa.array(texts))
        got = [dict(zip(bucket[text == i].tolist(), number[text == i].tolist())) for i in range(len(texts))]
        assert got == [plain_grams(t) for t in texts]


def test_inference_against_plain(model):
    """The chosen set and shares of each document equal those of loops over its n-grams."""
    rng = np.random.default_rng(3)
    words = (EN + DE + RU).split()
    texts = [" " + " ".join(rng.choice(words, n)) + " " for n in (1, 2, 5, 20, 60)] + [f" {x}" for x in (EN, DE + EN, RU + DE + EN)]
    text, bucket, number = li.grams(pa.array([t.lower() for t in texts]))
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    shares, _ = li.infer(model, bucket, number, cuts, 4.0, 10)
    for i in range(len(texts)):
        own = slice(cuts[i], cuts[i + 1])
        p = np.exp(model.logs[:, bucket[own]].astype(float))
        p = np.maximum(p / p.max(0), 1e-12)
        c = number[own] / li.SIZE

        def fit(langs):
            s = np.full(len(langs), 1 / len(langs))
            for _ in range(10):
                s = np.array([sum(c[j] * s[a] * p[l, j] / sum(s[b] * p[m, j] for b, m in enumerate(langs)) for j in range(len(c))) for a, l in enumerate(langs)]) / c.sum()
            return s, sum(c[j] * np.log(sum(s[a] * p[l, j] for a, l in enumerate(langs))) for j in range(len(c)))

        price = 4.0 * np.log1p(c.sum())
        single = [fit([k])[1] for k in range(3)]
        first = int(np.argmax(np.array(single) + model.prior))
        want, value = {first: 1.0}, single[first]
        full, most = fit([0, 1, 2])
        order = sorted(range(3), key=lambda k: (-2 if k == first else -full[k], k))
        for k in (2, 3):
            s, ll = fit(order[:k])
            if most - price <= single[first] or ll - (k - 1) * price <= value:
                break
            want, value = dict(zip(order[:k], s)), ll - (k - 1) * price
        assert {k for k in range(3) if shares[k, i] > 0} == set(want), texts[i]
        assert all(abs(shares[k, i] - s) < 1e-3 for k, s in want.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    found = queries.QUERIES["op12_language_id"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
