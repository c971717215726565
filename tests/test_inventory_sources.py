import hashlib
import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import contracts, inventory, logs
from quern.sources import binary, pinned, sinks, tables


def shard(path, tensors):
    at, header, body = 0, {"__metadata__": {"x": "y"}}, b""
    for name, (dtype, shape, data) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at, body = at + len(data), body + data
    raw = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + body)


def test_tensor_files(spark, rows, tmp_path):
    shard(tmp_path / "a.safetensors", {"x.weight": ("BF16", [2, 2], b"12345678"), "s": ("F32", [], b"abcd")})
    shard(tmp_path / "b.safetensors", {"y": ("I8", [3], b"xyz")})
    t = binary.tensor_inventory(spark, str(tmp_path))
    assert rows(t, "name", "shard", "dtype", "shape") == [("s", "a.safetensors", "F32", []), ("x.weight", "a.safetensors", "BF16", [2, 2]), ("y", "b.safetensors", "I8", [3])]
    assert rows(binary.tensor_hashes(t, str(tmp_path))) == sorted((n, hashlib.sha256(b).hexdigest()) for n, b in (("x.weight", b"12345678"), ("s", b"abcd"), ("y", b"xyz")))
    assert inventory.byte_violations(t).isEmpty() and inventory.region_violations(t, binary.shard_facts(t)).isEmpty()
    index = spark.createDataFrame([("x.weight", "a.safetensors"), ("s", "b.safetensors"), ("gone", "c.safetensors")], "name string, shard string")
    assert {(r[0], r[1]) for r in rows(inventory.reconcile(index, t))} == {("mapping_mismatch", "s"), ("missing_tensor", "gone"), ("unindexed_tensor", "y")}
    assert rows(inventory.shard_differences(index, t)) == [("missing_shard", "c.safetensors")]
    shard(tmp_path / "c.safetensors", {"y": ("I8", [1], b"x")})
    with pytest.raises(ValueError, match="duplicate tensor y"):
        binary.tensor_inventory(spark, str(tmp_path))
    for content in (b"123", struct.pack("<Q", 0), struct.pack("<Q", 50) + b"{}"):
        (tmp_path / "bad").write_bytes(content)
        with pytest.raises(ValueError):
            binary.read_header(tmp_path / "bad")
    assert binary.bad_scales(b"\x00\x00") and binary.bad_scales(b"\x80\x7f") and not binary.bad_scales(b"\x80\x3f")


def test_arrow_shards(spark, rows, tmp_path):
    for k, values in enumerate(([1, 2], [3], [4])):
        table = pa.table({"v": pa.array(values, pa.int64())})
        with pa.OSFile(str(tmp_path / f"d-train-{k}.arrow"), "wb") as f:
            with (pa.ipc.new_stream if k == 1 else pa.ipc.new_file)(f, table.schema) as w:
                w.write_table(table)
    binary.register(spark)
    got = spark.read.format("arrowshards").option("pattern", "*-train-*.arrow").load(str(tmp_path))
    assert rows(got) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_tables(spark, rows, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": {"c": [1]}}\n')
    assert rows(tables.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int")) == [(1,), (2,)]
    docs = tables.read_json_rows(spark, str(tmp_path / "j.jsonl"))
    assert rows(tables.with_source_index(docs, ["offset_key"]).select("source_index", F.variant_get("document", "$.a", "int"))) == [(0, 1), (1, None), (2, 2)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    folder = tmp_path / "run"
    folder.mkdir()
    (folder / "samples_my_20_task_2024-01-01T00-00-00.jsonl").write_text('{"doc_id": 1, "doc_hash": "h", "filter": "none", "acc": 0.5}\n{"doc_id": 2, "doc_hash": "h", "filter": "strict", "acc": 1}\n{"doc_id": 3, "doc_hash": "h", "acc": 1}\n{"doc_id": 4, "doc_hash": "g", "filter": "none", "acc": [1.0, 2.0]}\n')
    assert rows(tables.read_samples(spark, str(folder), "acc")) == [("my_20_task", 1, "h", 0.5), ("my_20_task", 4, "g", 1.0)]
    assert tables.find_one(str(folder), "samples_*.jsonl").name.startswith("samples_my")
    with pytest.raises(ValueError):
        tables.find_one(str(folder), "results_*.json")
    (folder / "x.bin").write_bytes(b"abc")
    got = {r["path"]: (r["size_bytes"], r["sha256"]) for r in tables.file_manifest(spark, str(folder)).collect()}
    assert got["x.bin"] == (3, hashlib.sha256(b"abc").hexdigest()) and len(got) == 2
    assert tables.read_whole_texts(spark, str(folder / "x.bin")).first()["text"] == "abc"
    assert tables.capped_copy(str(folder / "x.bin"), str(folder / "y.bin")) == b"abc"
    with pytest.raises(ValueError):
        tables.capped_copy(str(folder / "x.bin"), str(folder / "z.bin"), 2)
    assert tables.read_optional_json(str(folder / "no.json")) is None
    assert tables.identity_row(spark, ["pyspark", "no-such-package"], "r").first()["packages"]["no-such-package"] is None


def test_catalogue(spark, rows, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.range(2).write.parquet(str(tmp_path / "v"))
    c = pinned.Catalog(spark, [pinned.Source("d", "r1", {"__default__": {"valid": str(tmp_path / "v"), "train": str(tmp_path / "t")}})])
    assert c.load("d").count() == 3 and c.load("d", "r1", split="valid").first()["split"] == "valid"
    for bad in (("e", None), ("d", "r2")):
        with pytest.raises(LookupError):
            c.load(*bad)
    assert rows(c.split_counts(), "split", "n_rows") == [("train", 3), ("valid", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 0.5), ("b", 3, None)], "source string, tokens long, delta double")
    sinks.write_corpus(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_corpus(df, str(tmp_path / "c"))
    assert sinks.manifest(df, seed=42)["total_tokens"] == 5
    sinks.atomic_json(str(tmp_path / "m.json"), {"b": 1, "a": [1]})
    assert (tmp_path / "m.json").read_text().index('"a"') < (tmp_path / "m.json").read_text().index('"b"')
    with pytest.raises(ValueError):
        sinks.atomic_json(str(tmp_path / "n.json"), {"x": float("nan")})
    assert not list(tmp_path.glob(".n.json*")) and not (tmp_path / "n.json").exists()
    with sinks.Staged(str(tmp_path / "s")) as folder:
        (folder / "f").write_text("x")
    assert (tmp_path / "s/f").exists()
    with pytest.raises(FileExistsError), sinks.Staged(str(tmp_path / "s")):
        pass
    assert "| a | 2 | +0.500000 |" in sinks.markdown_table(df, ("delta",)) and "—" in sinks.markdown_table(df)
    with pytest.raises(ValueError):
        sinks.content_free(df.withColumn("text", F.lit("x")))


def test_kinds(spark):
    names = [("model.embed_tokens.weight", [2, 2], "Embedding", "embeddings"), ("lm_head.weight", [2, 2], "Linear (lm_head)", "lm_head"), ("model.layers.0.input_layernorm.weight", [2], "Normalization", "normalization"), ("m.linear_attn.conv1d.weight", [2, 1, 4], "Depthwise Conv1d", "recurrent_gdn"), ("model.visual.patch_embed.proj.weight", [2], "Vision patch projection", "vision"), ("m.mlp.up_proj.weight", [2, 2], "Linear", "text_mlp"), ("m.mlp.up_proj.weight", [2], "Parameter", "text_mlp"), ("mtp.norm.weight", [2], "Normalization", "mtp"), ("x", [], "Parameter", "other")]
    df = spark.createDataFrame(names, "name string, shape array<long>, kind string, component string")
    assert df.where(inventory.tensor_kind(F.col("name"), F.col("shape")) != F.col("kind")).isEmpty()
    assert df.where(inventory.tensor_component(F.col("name")) != F.col("component")).isEmpty()


def test_packed(spark, rows):
    source = spark.createDataFrame([("a.weight", "BF16", [128, 256]), ("n", "BF16", [4])], "name string, dtype string, shape array<long>")
    targets = spark.createDataFrame([("a", [128, 256])], "name string, shape array<long>")
    good = [("a.weight_packed", "I32", [128, 32]), ("a.weight_scale", "BF16", [128, 2]), ("a.weight_shape", "I64", [2]), ("n", "BF16", [4])]
    df = lambda x: spark.createDataFrame(x, source.schema)
    assert inventory.packed_violations(targets, source, df(good)).isEmpty()
    assert {r[0] for r in rows(inventory.packed_violations(targets, source, df([("a.weight_packed", "I32", [128, 31]), *good[1:3], ("extra", "F32", [])])))} == {"tensor_form", "missing_tensor", "extra_tensor"}
    families = spark.createDataFrame([("up_proj", 2, [2, 2])], "suffix string, expected_count int, expected_shape array<long>")
    found = spark.createDataFrame([("m.up_proj", "up_proj")], "name string, suffix string")
    t = spark.createDataFrame([("m.up_proj.weight", [2, 3])], "name string, shape array<long>")
    assert {r[0] for r in rows(inventory.target_violations(found, t, families, 2))} == {"family_count", "family_shape", "target_total"}


def profile(**changes):
    p = {"schema_version": 1, "id": "p", "model_id": "m", "recipe": "r", "checkpoint_name": "c", "image": "i", "hardware": {"gpu_count": 2, "gpu_memory_gib": 24, "compute_capability": "8.6"}, "runtime": {"tensor_parallel_size": 2, "pipeline_parallel_size": 1, "max_model_len": 98304, "dtype": "bfloat16", "kv_cache_dtype": "fp8", "kv_cache_memory_bytes": 1, "cpu_offload_gb": 0, "enforce_eager": False, "language_model_only": True, "max_num_batched_tokens": 2048, "max_num_seqs": 1, "enable_prefix_caching": True, "enable_chunked_prefill": True, "speculative_decoding": False}, "generation": {"seed": 42, "enable_thinking": False, "generation_config": "vllm"}, "server": {"served_model_name": "s", "enable_auto_tool_choice": True, "tool_call_parser": "qwen3_xml", "request_logging": False}, "environment": {"VLLM_USE_FLASHINFER_SAMPLER": "0"}, "evidence": {"status": "ok", "reports": [], "origin": {"repository": "r", "commit": "0" * 40, "path": "p"}, "required_log_evidence": {}}}
    for path, value in changes.items():
        at = p
        *parents, last = path.split("__")
        for k in parents:
            at = at[k]
        at[last] = value
    return p


@pytest.mark.parametrize("path,value,rule", [("schema_version", True, "schema_version"), ("id", "-x", "id"), ("hardware__gpu_count", 3, "parallelism"), ("runtime__dtype", "float16", "dtype"), ("runtime__max_num_seqs", 0, "max_num_seqs"), ("runtime__cpu_offload_gb", 0.0, "offload"), ("runtime__extra", 1, "runtime_keys"), ("generation__seed", -1, "seed"), ("server__served_model_name", "", "served_model_name"), ("evidence__origin__commit", "abc", "evidence_origin"), ("environment", {}, "environment")])
def test_profiles(spark, rows, path, value, rule):
    assert contracts.profile_violations(spark, [profile()]).isEmpty()
    assert rule in {r[0] for r in rows(contracts.profile_violations(spark, [profile(**{path: value})]))}


def test_contracts(spark, rows):
    contracts.require(contracts.profile_violations(spark, [profile()]))
    with pytest.raises(contracts.ContractError, match="duplicate_id"):
        contracts.require(contracts.profile_violations(spark, [profile(), profile()]))
    assert {r[0] for r in rows(contracts.binding_violations(spark, ["0", "0", "x"], 2))} == {"device_count", "device_repeated", "device_form"}
    assert rows(contracts.override_violations(spark, {"max_model_len": 1, "dtype": 2}, {"max_model_len"}), "key") == [("dtype",)]
    group = {s: dict(f) for s, f in contracts.W8A8.items()}
    good = {"quant_method": "compressed-tensors", "format": "int-quantized", "quantization_status": "compressed", "config_groups": {"g": group}}
    assert contracts.w8a8_violations(spark, good).isEmpty() and contracts.locate_quantization({"compression_config": good}) == good
    assert rows(contracts.w8a8_violations(spark, {**good, "config_groups": {"g": {**group, "weights": {**group["weights"], "num_bits": 4}}}}), "key") == [("num_bits",)]
    answers = spark.createDataFrame([("a", "391"), ("a", "391"), ("b", "391"), ("b", "392"), ("c", None)], "p string, t string")
    assert {r[1] for r in rows(contracts.identical_responses(answers, "p", "t", "391"))} == {"b", "c"}
    host = spark.createDataFrame([("ram", 64.0), ("disk", 10.0)], "fact string, value double")
    assert rows(contracts.host_violations(host, {"ram": ("least", 32), "disk": ("least", 50), "gpu": ("least", 1)}), "key") == [("disk",), ("gpu",)]
    manifest = spark.createDataFrame([("d", [], 1_400_000, [("a" * 40,)])], "corpus_sha256 string, failures array<string>, total_tokens long, sources array<struct<revision:string>>")
    assert contracts.manifest_gate(manifest, "d", 1, 1_300_000, 1_700_000).isEmpty()
    assert len(rows(contracts.manifest_gate(manifest, "e", 2, 1, 2))) == 3
    before = spark.createDataFrame([("m", "1"), ("n", "2")], "model string, identity_sha256 string")
    assert rows(inventory.manifest_changes(before, before.where("model = 'm'")), "key") == [("n",)]


def test_logs(spark):
    df = spark.createDataFrame([("none",)], "t string")
    good = spark.createDataFrame([("GPU KV cache size: 20,992 tokens\nGPU KV cache size: 20,992 tokens",)], "t string")
    assert good.select(logs.single_number(F.col("t"), logs.CAPACITY, "capacity")).first()[0] == 20992
    with pytest.raises(Exception, match="expected one capacity"):
        df.select(logs.single_number(F.col("t"), logs.CAPACITY, "capacity")).collect()
    errors = spark.createDataFrame([("torch.OutOfMemoryError: secret text",), ("",)], "m string")
    assert [r[0] for r in errors.select(logs.redacted_error(F.col("m"))).collect()] == ["torch.OutOfMemoryError", None]
