"""Exact medians by rounds, and breaches scanned in ranges, against plain loops."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.functions.median import exact_median
from quern.operators import telemetry


@pytest.mark.parametrize("few, pivots", [(8, 4), (1, 2), (4096, 32)])
def test_median(spark, few, pivots):
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1)) for _ in range(301)] + [("b", float(rng.randrange(3))) for _ in range(400)] + [("c", 10 ** rng.uniform(-200, 200)) for _ in range(150)] + [(None, float(k)) for k in range(10)]
    rows += [("d", None), ("e", 1.0), ("e", 2.0), ("f", float("inf")), ("f", 3.0), ("g", 7.0)] + [("h", 5.0)] * 60 + [("h", 9.0)] * 60
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    values = lambda k: [v for q, v in rows if q == k and v is not None]
    got = {r["k"]: r["median"] for r in exact_median(df, "v", ["k"], few, pivots).collect()}
    assert got == {k: statistics.median(values(k)) for k in {r[0] for r in rows} - {"d"}}
    assert exact_median(df, "v", [], few, pivots).first()["median"] == statistics.median([v for _, v in rows if v is not None])
    assert exact_median(df.limit(0), "v", ["k"], few, pivots).count() == 0


def test_distribution_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None)], "k string, v double")
    got = {r["k"]: (r["count"], r["median"], r["mean"]) for r in telemetry.distribution(df, "v", ["k"]).collect()}
    assert got == {None: (2, 2.5, 2.5), "a": (0, None, None)}


T0 = dt.datetime(2024, 1, 1)


def loops(series, seconds):
    """(consecutive runs, sustained alarms) of (key, second, seq, value) rows, as plain loops."""
    runs, alarms = {}, {}
    for key in {r[0] for r in series}:
        island, start = 0, None
        for _, t, seq, v in sorted((r for r in series if r[0] == key), key=lambda r: (r[1], r[2])):
            if v is not None and v > 5:
                start = t if start is None else start
                runs[key, island] = runs.get((key, island), 0) + 1
                if t - start >= seconds and (key, island) not in alarms:
                    alarms[key, island] = start, t, "high+very" if v > 50 else "high"
            else:
                island, start = island + 1, None
    return runs, alarms


@pytest.mark.parametrize("partitions", [1, 7])
def test_scan_against_loops(spark, partitions):
    rng = random.Random(4)
    series = []
    for key, n, p in (("one", 400, 0.02), ("two", 60, 0.3), (None, 50, 0.1), ("all", 120, 0.0), ("none", 30, 1.0)):
        t = 0
        for seq in range(n):
            t += rng.randrange(3)
            series.append((key, t, seq, None if rng.random() < p / 2 else 1.0 if rng.random() < p else rng.choice([9.0, 99.0])))
    rng.shuffle(series)
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), s, v, 1) for k, t, s, v in series], "k string, ts timestamp, seq long, v double, island int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs, alarms = loops(series, 20)
        got = telemetry.consecutive_breaches(df.drop("island"), "k", ["ts", "seq"], F.col("v") > 5, 3)
        assert {(r["k"], r["island"]): r["samples"] for r in got.collect()} == {k: n for k, n in runs.items() if n >= 3}
        found = telemetry.sustained_breaches(df.drop("island"), "k", "ts", ["ts", "seq"], {"high": F.col("v") > 5, "very": F.col("v") > 50}, 20)
        assert {(r["k"], r["island"]): ((r["started"] - T0).total_seconds(), (r["raised_at"] - T0).total_seconds(), r["reasons"]) for r in found.collect()} == alarms
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_long_series_is_dealt_to_all_tasks(spark):
    """A single series of a million samples: ranges are of like size, and its one run is found whole."""
    df = spark.range(1_000_000).selectExpr("'k' AS k", "timestamp_seconds(id) AS ts", "id AS seq", "if(id = 500000, 1.0D, 9.0D) AS v")
    ranges = telemetry._scanned(df, "k", "ts", ["seq"], F.col("v") > 5)
    assert {(r["island"], r["count"]) for r in ranges.groupBy("island").count().collect()} == {(0, 500_000), (1, 499_999)}
    spread = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(spread) > 1 and max(spread) < 800_000
    found = telemetry.sustained_breaches(df, "k", "ts", ["seq"], {"high": F.col("v") > 5}, 400_000)
    assert [(r["island"], r["reasons"]) for r in found.orderBy("island").collect()] == [(0, "high"), (1, "high")]
