import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import telemetry
from quern.sources import tables
from quern.streaming import alarms

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def series(values, step=1, key="k"):
    return [(key, T0 + dt.timedelta(seconds=i * step), i, float(v)) for i, v in enumerate(values)]


SCHEMA = "k string, ts timestamp, seq long, v double"


def test_consecutive(spark, rows):
    df = spark.createDataFrame(series([9, 9, 9, 9, 1, 9, 9, 9, 9, 9, 9]) + series([9] * 4, key="j"), SCHEMA)
    assert rows(telemetry.consecutive_breaches(df, "k", ["seq"], F.col("v") > 5)) == [("k", 1, 6)]


def test_sustained(spark, rows):
    df = spark.createDataFrame(series([9] * 10 + [1] + [9] * 5 + [99] * 8), SCHEMA)
    found = telemetry.sustained_breaches(df, "k", "ts", ["seq"], {"high": F.col("v") > 5, "very": F.col("v") > 50}, 10)
    assert rows(found.select(F.unix_timestamp("raised_at") - int(T0.timestamp()), "reasons")) == [(21, "high+very")]  # 9 s, then recovery: no alarm


def test_streams_equal_batch(spark, rows, tmp_path):
    data = series([9] * 6 + [1] + [9] * 14) + series([1, 9] * 8, key="j")
    for part in range(3):
        spark.createDataFrame(data[part::1][part * 12 : part * 12 + 12] if False else [d for d in data if d[2] // 7 == part], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))

    def run(make, name, mode="append"):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    flagged = lambda s: s.withColumn("breach", F.col("v") > 5)
    got = run(lambda s: alarms.consecutive_alarms(flagged(s), "k", "ts", "breach"), "consecutive")
    assert rows(got, "k", "samples") == [("k", 5), ("k", 5)]
    named = lambda s: s.withColumn("reasons", F.when(F.col("v") > 5, "high"))
    got = run(lambda s: alarms.sustained_alarms(named(s), "k", "ts", "reasons", 10), "sustained")
    assert rows(got.select("k", F.unix_timestamp("raised_at") - int(T0.timestamp()))) == [("k", 17)]
    batch = spark.createDataFrame(data, SCHEMA)
    want = telemetry.sustained_breaches(batch, "k", "ts", ["seq"], {"high": F.col("v") > 5}, 10)
    assert rows(got, "k", "started", "raised_at") == rows(want, "k", "started", "raised_at")
    got = run(lambda s: alarms.running_extremes(s, "k", "v"), "extremes", "complete")
    assert rows(got) == [("j", 1.0, 9.0, 16), ("k", 1.0, 9.0, 21)]


def test_rollup_from_file(spark, rows, tmp_path):
    line = "2024-01-01T00:00:0{}Z\ts\t{}\t1\t2\t3\t{},7\t9\t10\t{}\t1\t{}"
    (tmp_path / "t.tsv").write_text("\n".join(line.format(k, 50 - k, k, 5 * k, 2 * k) for k in range(3)) + "\n")
    row = telemetry.stage_rollup(tables.read_telemetry(spark, str(tmp_path / "t.tsv"))).first()
    assert (row["samples"], row["minimum_mem_available_kib"], row["maximum_gpu_memory_mib"], row["psi_delta_full_usec"], row["swap_out_delta_bytes"], row["last_timestamp"]) == (3, 48, [2, 7], 10, 4 * 4096, "2024-01-01T00:00:02Z")


def test_distribution_and_limits(spark):
    row = telemetry.distribution(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").first()
    assert (row["count"], row["median"], row["minimum"], row["maximum"]) == (3, 2.0, 1.0, 4.0) and row["population_standard_deviation"] == pytest.approx(1.247219128924647)
    assert telemetry.resource_limits()["max_swap_growth_bytes"] == 32 << 30
    for bad in (0, -1, True, "32", 1.5):
        with pytest.raises(ValueError):
            telemetry.resource_limits(max_swap_growth_gib=bad)


def test_chunks(spark, rows):
    lines = [(1, 0.0, 0.5, 'data: {"choices":[{"text":""}]}'), (1, 0.0, 1.0, 'data: {"choices":[{"text":"a"}]}'), (1, 0.0, 3.0, 'data: {"choices":[],"usage":{"prompt_tokens":10,"completion_tokens":5}}'), (1, 0.0, 3.0, "data: [DONE]"), (1, 0.0, 3.0, "")]
    chunks = tables.read_chunks(spark, spark.createDataFrame(lines, "request_id long, started double, ts double, line string"))
    assert rows(telemetry.stream_timings(chunks)) == [(1, 1.0, 3.0, 10, 5, 10.0, 2.0, 2.0)]
    with pytest.raises(Exception, match="no text or usage"):
        telemetry.stream_timings(chunks.where("usage is null") if "usage" in chunks.columns else chunks.where("prompt_tokens is null")).collect()
