"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import glob
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
import regex

from quern.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def same(df, columns, relation):
    left = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    names = relation.columns
    assert sorted(names) == sorted(columns)
    right = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(found, sorted(found.columns), duck.sql(catalog.ORACLES[name]))
    else:
        assert found.columns and found.count() >= 0


def near(a, b, percent=85):
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


@pytest.fixture(scope="module")
def texts(spark):
    word = regex.compile(r"[\p{L}\p{N}_]+")
    sets = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = word.findall(r["text"].lower())
        sets[r["doc_id"]] = (r, {" ".join(w[k : k + 5]) for k in range(len(w) - 4)})
    return sets


def test_neardup_keep_against_one_pass(spark, texts):
    kept = []
    for id in sorted(texts):
        own = texts[id][1]
        if not own or not any(near(own, texts[k][1]) for k in kept if texts[k][1]):
            kept.append(id)
    found = {r["doc_id"] for r in catalog.neardup_keep(spark, SF).where("kept").collect()}
    assert found == set(kept)


def test_corpus_selection_against_one_pass(spark, texts):
    token = regex.compile(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")
    taken, tasks, want = [], set(), set()
    for k in range(20):
        spent, target = {"short": 0, "long": 0}, {"short": 2000, "long": 3000}
        own = [(hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, (r, _) in texts.items() if r["source"] == f"src{k}"]
        for _, i in sorted(own):
            r, grams = texts[i]
            n, identity = len(token.findall(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()
            open_ = [b for b in target if spent[b] < target[b]]
            bucket = "short" if 64 <= n <= 511 else "long" if 512 <= n <= 2048 else None
            if not open_:
                break
            if bucket not in open_ or identity in tasks or any(grams and texts[j][1] and near(grams, texts[j][1]) for j in taken):
                continue
            spent[bucket] += n
            tasks.add(identity)
            taken.append(i)
            want.add((i, bucket, n))
    assert {tuple(r) for r in catalog.corpus_selection(spark, SF).select("row_id", "bucket", "tokens").collect()} == want and want


def test_bootstrap_against_numpy(spark, duck):
    rows = duck.sql("SELECT d.lang, l.doc_id, quality - (1 - toxic) AS delta FROM labels l JOIN documents d USING (doc_id) ORDER BY d.lang, l.doc_id").fetchall()
    strata = [np.array([float(d) for k, _, d in rows if k == lang]) for lang in sorted({k for k, _, _ in rows})]
    rng = np.random.default_rng(42)
    draws = [sum(v[rng.integers(0, len(v), size=len(v))].sum() for v in strata) / len(rows) for _ in range(10_000)]
    found = catalog.bootstrap_ci(spark, SF).first()
    assert found["documents"] == len(rows) and np.allclose([found["low"], found["high"]], np.quantile(draws, [0.025, 0.975]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
