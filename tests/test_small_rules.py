"""Rules and readers that no query runs, on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import contracts, corpus, inventory, overlap, requests
from quern.sources import sinks, tables


def test_counts_and_placements(spark, rows):
    modules = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "name string, device int")
    assert rows(inventory.placements(modules)) == [(0, 2), (1, 1)]
    assert rows(inventory.count_violations(modules, F.col("device") == 0, 3, "on_first")) == [("on_first", "all", "3", "2")]
    assert inventory.count_violations(modules, F.col("device") == 0, 2, "on_first").isEmpty()
    expected = spark.createDataFrame([("x", 2), ("y", 1), ("z", 1)], "suite string, expected long")
    observed = spark.createDataFrame([("x", 2), ("y", 3), ("w", 1)], "suite string, observed long")
    assert rows(requests.group_count_violations(observed, expected, "suite")) == sorted([("document_count", "y", 1, 3), ("document_count", "z", 1, None), ("document_count", "w", None, 1)], key=repr)


def test_contract_rules(spark, rows):
    with pytest.raises(contracts.ContractError):
        contracts.exact_columns(spark.range(1).withColumn("x", F.lit(1)), {"id"}, "rows")
    contracts.exact_columns(spark.range(1), {"id"}, "rows")
    keys, catalog = spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string")
    assert rows(contracts.reference_violations(keys, catalog, "k", "unknown")) == [("unknown", "b", "present", None)]
    evidence = spark.createDataFrame([("r1", "d", "passed"), ("r2", "e", "passed"), ("r3", None, "failed")], "name string, corpus_sha256 string, status string")
    assert rows(contracts.joined_evidence(evidence, "d"), "rule", "key") == [("corpus_sha256", "r2"), ("corpus_sha256", "r3"), ("status", "r3")]
    checks = spark.createDataFrame([("c1", "passed", "s", "s"), ("c2", "passed", "t", "s"), ("c3", "open", "s", "s")], "name string, status string, corpus_state string, expected_state string")
    assert rows(contracts.readiness(checks), "rule", "key") == [("corpus_state", "c2"), ("status", "c3")]
    runs = spark.createDataFrame([("ok", 900, 100, 1), ("long", 900, 101, 1), ("none", 1, 1, 0)], "name string, prompt_tokens int, max_tokens int, repeats int")
    assert rows(contracts.context_bound_violations(runs, 1000), "rule", "key") == [("context", "long"), ("repeats", "none")]


def test_corpus_helpers(spark, rows):
    parts = spark.createDataFrame([([("a",), (None,), ("b",)],)], "p array<struct<text: string>>")
    assert parts.select(corpus.join_parts(F.col("p"))).first()[0] == "a  b"
    assert [corpus.largest_fit(*x) for x in ((2, 3, 16), (2, 20, 16), (0, 1, 16))] == [6, 0, 0]
    assert rows(corpus.positions(spark.range(5).withColumn("place", F.col("id")), "place", 2), "id") == [(0,), (1,)]
    meta = spark.range(1).select(F.create_map(F.lit("uuid"), F.lit("u"), F.lit("other"), F.lit("x")).alias("m"))
    assert meta.select(overlap.origin_metadata(F.col("m"))).first()[0] == {"uuid": "u"}


def test_readers(spark, rows, tmp_path):
    for k in range(2):
        (tmp_path / f"d{k}.json").write_text(json.dumps({"a": k, "b": {"c": "x"}}, indent=1))
    assert rows(tables.read_documents(spark, str(tmp_path / "*.json"), "a long, b struct<c: string>"), "a", "b.c") == [(0, "x"), (1, "x")]
    with pytest.raises(ValueError, match="no profiles"):
        tables.discover_profiles(str(tmp_path))
    (tmp_path / "p1.yaml").write_text("id: p1\nx: 1\n")
    assert tables.discover_profiles(str(tmp_path)) == [{"id": "p1", "x": 1}]
    (tmp_path / "p2.yaml").write_text("id: other\n")
    with pytest.raises(ValueError, match="declares the id"):
        tables.discover_profiles(str(tmp_path))
    path = str(tmp_path / "series")
    for k in range(2):
        sinks.append_telemetry(spark.createDataFrame([(f"t{k}", k)], "ts string, n int"), path)
    assert spark.read.option("sep", "\t").csv(path).count() == 2


def test_made_inputs(spark, rows):
    """Operators that make rows from nothing have no query."""
    ids = {r["row"]: r["input_ids"] for r in corpus.synthetic_ids(spark, 40, 16).collect()}
    assert ids == {r: [1 + (r * 17 + p) % 480 for p in range(16)] for r in range(40)}
    assert set(rows(corpus.prompt_sizes(spark, [16, 33, 64, 2], "more data ", "Read this now "))) == {(2, 0, 0), (16, 6, 15), (33, 15, 33), (64, 30, 63)}
    few = spark.range(5).withColumnRenamed("id", "k0")
    assert rows(corpus.repeat_cyclic(few, 12, "k0"), "place", "k0") == sorted(((p, p % 5) for p in range(12)), key=repr)
    assert rows(corpus.repeat_cyclic(few, 3, "k0"), "place", "k0") == [(p, p) for p in range(3)]
