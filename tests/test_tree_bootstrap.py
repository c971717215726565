"""Manifest trees and the files that changed; bootstrap over blocks, against plain Python."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from quern.operators import evalstats, inventory


def plain_tree(records, depth, step):
    """{(level, node): (records, digest)}."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = {}
    for path, size in records:
        leaves.setdefault(sha(path or "")[:depth], []).append(json.dumps({k: v for k, v in (("path", path), ("size", size)) if v is not None}, separators=(",", ":")))
    level = {k: (len(v), sha("\n".join(sorted(v)))) for k, v in leaves.items()}
    out, at = {(depth, k): v for k, v in level.items()}, depth
    while at:
        at = max(0, at - step)
        up = {}
        for k, (n, d) in sorted(level.items()):
            up.setdefault(k[:at], []).append((n, f"{k}:{d}"))
        level = {k: (sum(n for n, _ in v), sha("\n".join(x for _, x in v))) for k, v in up.items()}
        out |= {(at, k): v for k, v in level.items()}
    return out


def test_tree(spark):
    records = [(f"dir/{k}", k % 7) for k in range(300)] + [("dir/5", 5), (None, 1), ("", None)]
    df = spark.createDataFrame(records, "path string, size long")
    for depth, step in ((3, 2), (2, 1), (4, 4)):
        got = {(r["level"], r["node"]): (r["records"], r["sha256"]) for r in inventory.manifest_tree(df.repartition(5), ["path", "size"], depth=depth, step=step).collect()}
        assert got == plain_tree(records, depth, step)
    assert inventory.manifest_tree(df.limit(0), ["path", "size"]).count() == 0


def test_file_changes(spark, rows):
    before = [(f"f{k}", k) for k in range(200)] + [("twice", 1), ("twice", 2)]
    after = [(p, n + (p == "f17")) for p, n in before if p != "f9"] + [("new", 1), ("twice", 2)]
    left, right = spark.createDataFrame(before, "path string, size long"), spark.createDataFrame(after, "path string, size long")
    got = rows(inventory.file_changes(left, right, ["path", "size"], depth=3, step=2))
    one = lambda p, n: f'{{"path":"{p}","size":{n}}}'
    assert got == sorted([("changed_file", "f17", one("f17", 17), one("f17", 18)), ("missing_file", "f9", one("f9", 9), None), ("extra_file", "new", None, one("new", 1)), ("changed_file", "twice", one("twice", 1) + "\n" + one("twice", 2), one("twice", 1) + "\n" + one("twice", 2) + "\n" + one("twice", 2))], key=repr)
    assert inventory.file_changes(left, left.orderBy(F.rand()), ["path", "size"]).isEmpty()
    assert rows(inventory.file_changes(left.limit(0), right.limit(1), ["path", "size"]), "rule") == [("extra_file",)]


def test_bootstrap_in_blocks_against_numpy(spark):
    """The same streams, drawn by plain loops over the same blocks; and bounds like those of one plain bootstrap."""
    rng = random.Random(3)
    data = [("g", s, k, rng.gauss(0.1 * (s == "b"), 1)) for s, n in (("a", 700), ("b", 90), ("c", 1)) for k in range(n)] + [("h", "a", k, float(k % 2)) for k in range(50)]
    df = spark.createDataFrame(data, "suite string, task string, doc_id long, delta double").repartition(6)
    found = {r["suite"]: r for r in evalstats.bootstrap_in_blocks(df, ["suite"], "task", "doc_id", replicates=600, block_rows=100, chunk=250).collect()}
    place = df.select("suite", "task", "doc_id", "delta", F.xxhash64("suite", "task").alias("stratum"), F.xxhash64("doc_id").alias("hash")).collect()
    for suite, n in (("g", 791), ("h", 50)):
        sums = np.zeros(600)
        for task in {r["task"] for r in place if r["suite"] == suite}:
            own = [r for r in place if r["suite"] == suite and r["task"] == task]
            bits = max(0, int(np.ceil(np.log2(len(own) / 100))))
            of = lambda r: (r["hash"] % 2**64) >> (64 - bits) if bits else 0
            for block in {of(r) for r in own}:
                values = np.array([r["delta"] for r in sorted(own, key=lambda r: r["doc_id"]) if of(r) == block])
                path = []
                for level in range(bits):
                    node = block >> (bits - level)
                    inside = [of(r) for r in own if of(r) >> (bits - level) == node]
                    path.append((sum((b >> (bits - level - 1)) & 1 == 0 for b in inside), len(inside), (block >> (bits - level - 1)) & 1 == 0))
                for chunk in range(3):
                    size = min(250, 600 - 250 * chunk)
                    sums[250 * chunk : 250 * chunk + size] += evalstats.block_sums(values, len(own), path, own[0]["stratum"], block, chunk, size, 42)
        low, high = np.quantile(sums / n, [0.025, 0.975])
        assert np.allclose([found[suite]["low"], found[suite]["high"]], [low, high]) and found[suite]["documents"] == n
    one = {r["suite"]: r for r in evalstats.bootstrap(df, ["suite"], "task", "doc_id", replicates=4000).collect()}
    many = {r["suite"]: r for r in evalstats.bootstrap_in_blocks(df, ["suite"], "task", "doc_id", replicates=4000, block_rows=64, chunk=500).collect()}
    assert all(abs(one[s][b] - many[s][b]) < 0.02 for s in "gh" for b in ("low", "high"))


def test_blocks_take_all_draws():
    """Blocks of one stratum draw as many rows together as the stratum has, in each replicate."""
    sizes = [5, 3, 0, 8]
    paths = {0: [(8, 16, True), (5, 8, True)], 1: [(8, 16, True), (5, 8, False)], 3: [(8, 16, False), (0, 8, False)]}
    total = sum(evalstats.block_sums(np.ones(sizes[b]), 16, p, 7, b, 0, 50, 42) for b, p in paths.items())
    assert (total == 16).all()
