import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evalstats, requests


def test_metric(spark):
    df = spark.createDataFrame([({"acc,none": 0.75, "acc_norm,none": 0.5},), ], "m map<string,double>")
    assert df.select(evalstats.pick_metric(F.col("m"), "acc")).first()[0] == 0.75
    for bad in ({"acc,none": float("nan")}, {}, {"acc": 1.0, "acc,none": 1.0}):
        with pytest.raises(Exception, match="expected one finite"):
            spark.createDataFrame([(bad,)], "m map<string,double>").select(evalstats.pick_metric(F.col("m"), "acc")).collect()
    both = spark.createDataFrame([({"t": {"acc": 0.1}}, {"t": {"acc": 0.2}, "u": {"acc": 0.3}})], "g map<string,map<string,double>>, r map<string,map<string,double>>")
    assert tuple(both.select(evalstats.headline(F.col("g"), F.col("r"), "t", "acc"), evalstats.headline(F.col("g"), F.col("r"), "u", "acc")).first()) == (0.1, 0.3)


def test_bootstrap_equals_numpy(spark):
    strata = {"a": [0.0, 1.0], "b": [-1.0, 0.0, 1.0]}
    data = [("g", t, k, v) for t, vs in strata.items() for k, v in enumerate(vs)]
    got = evalstats.bootstrap(spark.createDataFrame(data, "suite string, task string, doc_id long, delta double"), ["suite"], "task", "doc_id", 100, 42).first()
    rng = np.random.default_rng(42)
    draws = []
    for _ in range(100):
        total = 0.0
        for key in sorted(strata):
            v = np.array(strata[key])
            total += v[rng.integers(0, len(v), size=len(v))].sum()
        draws.append(total / 5)
    assert (got["low"], got["high"], got["documents"]) == (*np.quantile(draws, [0.025, 0.975]), 5)


def test_pairing_rules(spark, rows):
    left = spark.createDataFrame([("t", 1, "h", 1.0), ("t", 1, "h", 1.0), ("t", 2, "h", 0.0), ("t", 3, "x", 1.0), ("u", 1, "h", 1.0)], evalstats.SAMPLES)
    right = spark.createDataFrame([("t", 1, "h", 0.0), ("t", 3, "y", 1.0)], evalstats.SAMPLES)
    assert {r[0] for r in rows(evalstats.pairing_violations(left, right))} == {"duplicate_left", "document_ids", "document_hash", "task_strata"}
    assert evalstats.pairing_violations(right, right).isEmpty()


@pytest.mark.parametrize("b,c", [(17, 13), (0, 0), (5, 0), (1, 1), (2000, 1800)])
def test_mcnemar(spark, b, c):
    n, k = b + c, min(b, c)
    expected = 1.0 if n == 0 else min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n if n < 1000 else 2 * math.exp(math.log(sum(math.comb(n, i) for i in range(k + 1))) - n * math.log(2))))
    got = spark.createDataFrame([(b, c)], "b long, c long").select(evalstats.mcnemar(F.col("b"), F.col("c"))).first()[0]
    assert got == pytest.approx(expected, rel=1e-9)
    if (b, c) == (17, 13):
        assert round(got, 4) == 0.5847


def test_decision(spark):
    schema = "scope string, missing_candidate array<string>, missing_baseline array<string>, macro_delta double, accepted boolean"
    cases = [(("paired", ["x"], [], None, None), "incomplete"), (("candidate-only", [], ["y"], None, None), "candidate_scores_only_no_retention_or_deployment_recommendation"), (("paired", [], ["y"], None, None), "candidate_scores_only_no_retention_or_deployment_recommendation"), (("paired", [], [], 0.0, True), "retention_accepted"), (("paired", [], [], -0.1, False), "retention_rejected")]
    for row, expected in cases:
        assert evalstats.decision(spark.createDataFrame([row], schema)).first()["decision"] == expected


def test_requests(spark, rows):
    schema = "task string, doc_id long, seq long, request_type string, context string, continuation string, max_gen_toks int"
    df = requests.encode_requests(spark.createDataFrame([("t", 1, 1, "loglikelihood", "a b  ", "c", None), ("t", 2, 2, "generate_until", "a b", None, None), ("t", 3, 3, "generate_until", "a", None, 7)], schema))
    assert rows(df, "seq", "rendered", "n_tokens", "context_tokens", "reserve") == [(1, "a b  c", 3, 2, 0), (2, "a b", 2, None, 256), (3, "a", 1, None, 7)]
    assert rows(requests.truncation_violations(df, 258), "key") == []
    assert rows(requests.truncation_violations(df, 3), "key") == [("t/1",), ("t/2",), ("t/3",)]
    own = [hashlib.sha256("".join(f"{len(x.encode())}:{x}" for x in ("t", kind, text, str(n), str(reserve))).encode()).hexdigest() for kind, text, n, reserve in (("loglikelihood", "a b  c", 3, 0), ("generate_until", "a b", 2, 256), ("generate_until", "a", 1, 7))]
    fold = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert rows(requests.stream_digest(df, ["task"]), "task", "request_count", "maximum_tokens", "stream_sha256") == [("t", 3, 258, fold([fold(own)]))]
    assert rows(requests.stream_digest(df, ["task"], block=2), "stream_sha256") == [(fold([fold(own[:1]), fold(own[1:])]),)]
    for bad in (("t", 1, 1, "loglikelihood", "", "c", None), ("t", 1, 1, "other", "a", "c", None)):
        with pytest.raises(Exception, match="empty context|unexpected request"):
            requests.encode_requests(spark.createDataFrame([bad], schema)).collect()


def test_logprobs(spark, rows):
    schema = "request_id long, token_ids array<int>, prompt_token_ids array<int>, logprobs array<double>, context_tokens int"
    good = spark.createDataFrame([(1, [5, 6, 7], [5, 6, 7], [None, -0.5, -0.25], 2)], schema)
    assert rows(requests.logprob_summary(good)) == [(1, 2, 1, -0.25)]
    for bad in ((1, [5, 6], [5], [None, -0.5], 1), (1, [5, 6], [5, 6], [None, None], 1), (1, [5, 6], [5, 6], [-1.0, -0.5], 1), (1, [5, 6], [5, 6], [None, float("inf")], 1)):
        with pytest.raises(Exception, match="incomplete"):
            requests.logprob_summary(spark.createDataFrame([bad], schema)).collect()


def test_constraints(spark, rows):
    df = spark.createDataFrame([(["a", "b"], [True, False]), (["a"], [True])], "k array<string>, p array<boolean>")
    assert rows(evalstats.constraint_counts(df, "k", "p")) == [("a", 2, 2), ("b", 1, 0)]
    assert sorted(r[0] for r in df.select(evalstats.strict_pass(F.col("p"))).collect()) == [False, True]


def test_bootstrap_query_draws_10000(spark, tmp_path):
    from quern.plans import catalog

    quality, toxic = [3, 14, 159, 26, 53, 58, 979], [0, 0, 1, 0, 0, 1, 1]  # wide values, so that bounds differ
    labels = [(k, q, t) for k, (q, t) in enumerate(zip(quality, toxic, strict=True))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, "de" if k < 3 else "en") for k in range(7)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()
    deltas = np.array([float(q - (1 - t)) for _, q, t in labels])
    rng = np.random.default_rng(42)
    draws = [sum(v[rng.integers(0, len(v), size=len(v))].sum() for v in (deltas[:3], deltas[3:])) / 7 for _ in range(10_000)]
    few = np.quantile(draws[:1000], [0.025, 0.975])
    low, high = np.quantile(draws, [0.025, 0.975])
    assert (got["low"], got["high"], got["documents"]) == (low, high, 7)
    assert (low, high) != tuple(few)
