"""Resumable stages, recovery, request identity and the offset round trip."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import contracts, resume
from quern.sources import binary
from tests.test_inventory_sources import profile


def stages(seen):
    def first(spark, _):
        seen.append("first")
        return spark.range(10).withColumn("x", F.col("id") * 2)

    def second(spark, before):
        seen.append("second")
        return before.where("id % 2 = 0")

    def third(spark, before):
        seen.append("third")
        return before.agg(F.sum("x").alias("total"))

    return [("first", first), ("second", second), ("third", third)]


def test_resume(spark, tmp_path):
    root, seen = f"file://{tmp_path}/run", []
    with pytest.raises(FileNotFoundError):
        resume.run_stages(spark, root, stages(seen), {"corpus": "a"}, resume=True)
    with pytest.raises(resume.Interrupted):
        resume.run_stages(spark, root, stages(seen), {"corpus": "a"}, stop_after=2)
    with pytest.raises(FileExistsError):
        resume.run_stages(spark, root, stages(seen), {"corpus": "a"})
    with pytest.raises(ValueError, match="identity"):
        resume.run_stages(spark, root, stages(seen), {"corpus": "b"}, resume=True)
    with pytest.raises(ValueError, match="stages"):
        resume.run_stages(spark, root, stages(seen)[:1], {"corpus": "a"}, resume=True)
    assert len(list((tmp_path / "run").glob("generation-*"))) == 1
    assert resume.run_stages(spark, root, stages(seen), {"corpus": "a"}, resume=True).collect() == [(40,)]
    assert seen == ["first", "second", "third"]
    assert resume.run_stages(spark, root, stages(seen), {"corpus": "a"}, resume=True).collect() == [(40,)] and seen[-1] == "third" and len(seen) == 3


def test_one_writer(spark, tmp_path):
    """A second run is refused before it works; a stale lease can be taken over, and its slow owner then can't swap the pointer."""
    root, seen = f"file://{tmp_path}/run", []

    def slow(session, _):
        seen.append("slow")
        with pytest.raises(resume.Refused):
            resume.run_stages(session, root, stages(seen), {})
        assert seen == ["slow"]
        assert resume.run_stages(session, root, stages(seen), {"run": 2}, take_over=True).collect() == [(40,)]
        return session.range(3)

    with pytest.raises(resume.Refused, match="taken over"):
        resume.run_stages(spark, root, [("slow", slow)], {})
    pointer = json.loads((tmp_path / "run/current.json").read_text())
    assert pointer["identity"] == {"run": 2} and pointer["fence"] == 2 and not list((tmp_path / "run").glob("writer-*"))
    assert resume.run_stages(spark, root, stages(seen), {"run": 2}, resume=True).collect() == [(40,)]
    first = resume.take_lease(spark, root)
    with pytest.raises(resume.Refused):
        resume.take_lease(spark, root)
    second = resume.take_lease(spark, root, stale_after=0.0)
    with pytest.raises(resume.Refused):
        first.renew()
    first.give_back()
    second.renew()
    second.give_back()
    assert not list((tmp_path / "run").glob("writer-*"))


def test_resume_checks_files(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    with pytest.raises(resume.Interrupted):
        resume.run_stages(spark, root, stages([]), {}, stop_after=1)
    pointer = json.loads((tmp_path / "run/current.json").read_text())
    part = next((tmp_path / "run" / pointer["directory"]).glob("*.parquet"))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(ValueError, match="files differ"):
        resume.run_stages(spark, root, stages([]), {}, resume=True)
    (tmp_path / "run/current.json").write_text(json.dumps(pointer | {"directory": "../elsewhere"}))
    for crc in (tmp_path / "run").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="generation"):
        resume.run_stages(spark, root, stages([]), {}, resume=True)


def test_request_identity(spark, rows):
    config = {"bos_token": None, "eos_token": "<end>", "pad_token": "<pad>", "token_ids": {"<end>": 5, "<pad>": 6}, "chat_template": "t", "add_bos_token": False}
    special = {"bos_token_id": None, "eos_token_id": 5, "pad_token_id": 6}
    check = lambda one, two, seen={"largest_request": 9, "maximum_tokens": 9}: rows(contracts.request_identity_violations(spark, one, two, special, 9, seen), "rule", "key")
    assert check(config, config) == []
    assert check(config | {"chat_template": "u"}, config) == [("identity", "chat_template_sha256")]
    assert check(config | {"token_ids": {"<end>": 7, "<pad>": 6}}, config) == [("identity", "eos_token_id"), ("special_token", "eos_token_id")]
    assert check(config, config | {"add_bos_token": True}) == [("adds_bos_token", "source")]
    assert check(config, config, {"largest_request": 8, "maximum_tokens": 9}) == [("maximum_request", "expected"), ("maximum_request", "suite")]


def test_recovery(spark, rows):
    report = {"status": "failed", "profile": "pilot", "corpus_sha256": "c", "source_revision": "r", "peaks": {"safety_trigger": None, "samples": 3}}
    audit, corpus = {"source": {"revision": "r", "shard_sha256": {"a": "1", "b": "2"}}}, {"corpus_sha256": "c"}
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    check = lambda r, f=files, digest="c": rows(contracts.recovery_violations(spark, r, "pilot", audit, corpus, f, digest), "rule", "key")
    assert check(report) == []
    assert check(report | {"status": "passed"}) == [("status", "report")]
    assert check(report | {"peaks": {"safety_trigger": "swap", "samples": 0}}) == [("safety_trigger", "peaks"), ("samples", "peaks")]
    assert check(report, files.where("name = 'a'"), "d") == [("corpus_sha256", "file"), ("source_changed", "b")]


def test_resolved_profile(spark, tmp_path):
    (tmp_path / "lock").write_bytes(b"x")
    found = contracts.resolve_profile(profile(), {"lock": str(tmp_path / "lock")}, overrides={"max_model_len": 4096}, spark=spark)
    assert found["profile"]["runtime"]["max_model_len"] == 4096 and found["devices"] == ["0", "1"]
    assert found["source"] == {"lock_sha256": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}
    for bad in ({"overrides": {"seed": 1}}, {"devices": ["0", "0"]}, {"overrides": {"max_model_len": 0}}):
        with pytest.raises(contracts.ContractError):
            contracts.resolve_profile(profile(), {}, spark=spark, **bad)


def test_offset_round_trip():
    def nearest(x):  # of all 16-bit brain floats, by value; the even one of two as near
        bits = np.arange(1 << 16, dtype=np.uint32)
        values = (bits << 16).view(np.float32).astype(np.float64)
        sound = np.isfinite(values)
        gap = np.where(sound, np.abs(values - x), np.inf)
        best = np.flatnonzero(gap == gap.min())
        return int(min(best, key=lambda b: (b & 1, b)))

    value = lambda b: float((np.array([b], np.uint32) << 16).view(np.float32)[0])
    rng = np.random.default_rng(2)
    source = np.array([nearest(x) for x in rng.normal(0, 1, 60)], "<u2")
    want = [nearest(value(nearest(np.float32(value(int(b))) + np.float32(1))) - 1) for b in source]
    got = np.frombuffer(binary.offset_round_trip(source.tobytes()), "<u2")
    assert [value(int(b)) for b in got] == [value(b) for b in want]
    assert binary.offset_round_trip_holds(source.tobytes(), got.tobytes())
    assert not binary.offset_round_trip_holds(source.tobytes(), source.tobytes())
    assert not binary.offset_round_trip_holds(np.array([0x7F80], "<u2").tobytes(), np.array([0x7F80], "<u2").tobytes())
