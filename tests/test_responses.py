"""Responses assembled with state and timers from file streams, and silence alarms."""

import datetime as dt

import pytest

from quern.streaming import responses

T0 = dt.datetime(2024, 1, 1)
CHUNKS = "request_id string, ts timestamp, number int, text string, done boolean"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Run a stream over batches of rows, one file each, and give its rows."""
    responses.use_rocksdb(spark)

    def run(batches, schema, make, name):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{k:03d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_assembled(streamed):
    batches = [
        [("a", at(1), 1, "lo ", False), ("b", at(1), 0, None, False), ("c", at(2), 0, "lost", False)],
        [("a", at(2), 0, "Hel", False), ("a", at(2), 0, "again", False), ("b", at(3), 2, "!", True)],
        [("a", at(4), 2, "you", True), ("c", at(3), 3, " end", True)],
        [("a", at(5), 1, "late", False), ("b", at(6), 1, "yes", False)],
        [("z", at(400), 0, "tick", True)],  # time goes on: c gets nothing more
        [("z2", at(401), 0, "tock", True)],
    ]
    got = {r["request_id"]: tuple(r)[1:] for r in streamed(batches, CHUNKS, lambda s: responses.assembled_responses(s, silence=100), "assembled")}
    assert got["a"] == ("complete", "Hello you", 3, 0, at(1), at(4))
    assert got["b"] == ("complete", "yes!", 3, 0, at(3), at(6))
    assert got["c"] == ("incomplete", "lost end", 2, 2, at(2), at(3))
    assert got["z"][:2] == ("complete", "tick") and len(got) == 5


def test_stream_equals_batch(spark, streamed):
    """Any split of the chunks to batches gives the same responses."""
    texts = {f"r{k}": [f"{k}.{i} " for i in range(1 + k % 4)] for k in range(12)}
    rows = [(r, at(i), i, t, i == len(own) - 1) for r, own in texts.items() for i, t in enumerate(own)]
    for name, order in (("forward", rows), ("backward", rows[::-1])):
        got = streamed([order[:7], order[7:9], order[9:]], CHUNKS, lambda s: responses.assembled_responses(s, silence=100, delay="60 seconds"), name)
        assert {r["request_id"]: (r["status"], r["text"], r["missing"]) for r in got} == {r: ("complete", "".join(own), 0) for r, own in texts.items()}


def test_silence(streamed):
    batches = [[("a", at(0)), ("b", at(1))], [("b", at(40))], [("b", at(80))], [("b", at(90))], [("b", at(120)), ("a", at(121))], [("b", at(160))], [("b", at(161))]]
    got = streamed(batches, "k string, ts timestamp", lambda s: responses.silence_alarms(s, "k", "ts", 50, delay="1 second"), "silence")
    assert [tuple(r) for r in got] == [("a", at(0), at(50))]
