"""What a task or a worker holds doesn't grow with the table."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quern.llm import collocations
from quern.operators import dedup, inventory, selection
from quern.plans import catalog


def test_targets_broadcast_suffixes_only(spark, rows, tmp_path):
    names = ["a.b.up_proj", "a.b.up_proj", "a.mlp.up_proj", "up_proj", "a.é.ünd", "a.", "a.b.other", None]
    spark.createDataFrame([(n,) for n in names], "name string").write.parquet(str(tmp_path / "names"))
    suffixes = spark.createDataFrame([("up_proj",), ("mlp.up_proj",), ("mlp.up_proj",), ("é.ünd",), ("",), (None,)], "suffix string")
    found = inventory.select_targets(spark.read.schema("name string").parquet(str(tmp_path / "names")), suffixes, ".+")
    assert rows(found) == [("a.", ""), ("a.b.up_proj", "up_proj"), ("a.mlp.up_proj", "mlp.up_proj"), ("a.é.ünd", "é.ünd")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # A small file of names makes many endings: it is the suffixes that go to all machines; no name is sorted.
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortAggregate" not in plan


def test_reference_queries_bound_batches(spark, rows):
    for name in ("corpus_selection", "neardup_pairs", "decontaminated_docs"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000, name


def _sets(n, size):
    flat = np.sort(np.random.default_rng(3).integers(0, 1 << 63, (n, size), np.int64).view(np.uint64) << np.uint64(1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.array(flat.ravel().view(np.int64)))], names=["id__", "n", "grams"])


def test_sets_are_read_in_parts():
    batch = _sets(10_000, 300)
    expected = [np.bincount((np.array(s, np.int64).view(np.uint64) >> np.uint64(56)).astype(int), minlength=256).astype(np.uint8).tobytes() for s in batch.column("grams").slice(70, 5).to_pylist()]
    assert [p for part in dedup._profiles(iter([batch.slice(70, 5)])) for p in part.column("profile").to_pylist()] == expected
    for run, limit in ((dedup._profiles, 16), (dedup._prefixes(np.zeros(0, np.uint64), 85), 16)):
        tracemalloc.start()
        found = sum(len(part) for part in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == (10_000 if run is dedup._profiles else 10_000 * 46) and peak < limit << 20


def test_fold_holds_no_pairs():
    # 2,000 classes, all near to each other, by four million rows of pairs.
    n = 2000
    schema = pa.schema([("turn", pa.int32()), ("place", pa.int64()), ("row_id", pa.int64()), ("class_id", pa.int64()), ("identity", pa.string()), ("short_tokens", pa.float64()), ("long_tokens", pa.float64()), ("other", pa.int64())])

    def batches():
        for k in range(n):
            row = pa.RecordBatch.from_pylist([{"turn": 0, "place": k, "row_id": k, "class_id": k, "identity": f"t{k}", "short_tokens": 5.0}], schema)
            same = [pa.array(np.full(n, x), t) for x, t in ((0, pa.int32()), (k, pa.int64()), (k, pa.int64()), (k, pa.int64()))]
            pairs = pa.RecordBatch.from_arrays([*same, *(pa.nulls(n, schema.field(c).type) for c in ("identity", "short_tokens", "long_tokens")), pa.array(np.arange(n))], schema=schema)
            yield from (row, pairs.slice(0, 700), pairs.slice(700)) if k % 2 else (pa.concat_batches([row, pairs]),)

    tracemalloc.start()
    before = pa.total_allocated_bytes()
    found = list(selection.fold([selection.Budget("a", 1000, 1)])(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["row_id"] for b in found for r in b.to_pylist()] == [0]
    assert peak < 8 << 20 and pa.total_allocated_bytes() - before < 8 << 20


def test_phrases_are_written_in_parts():
    words = collocations.Words(pa.array(["Alpha beta, gamma " * 100_000]), pa.array(["en"]))
    tracemalloc.start()
    found = words.phrases(np.arange(250_000), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and len(found) == 250_000
    three = ["alpha beta gamma", "beta gamma alpha", "gamma alpha beta"]
    assert found.slice(16_380, 8).to_pylist() == [three[i % 3] for i in range(16_380, 16_388)]


def test_tally_holds_a_column_twice_at_most():
    tally, n = collocations.Tally(), 100_000
    tracemalloc.start()
    for part in range(10):
        own = np.arange(n, dtype=np.uint64) * np.uint64(part + 1)
        out = list(tally.add(own, own, np.full(n, 2), pa.array(["en"]).take(pa.array(np.zeros(n, int))), pa.array(own).cast(pa.string())))
        assert not out
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    out = list(tally.flush())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = {p: f for b in out for p, f in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True)}
    assert counts["0"] == 20 and sum(counts.values()) == 2 * n * 10 and len(counts) == sum(len(b) for b in out)
    assert peak - held < 28 << 20 and not list(tally.flush())
