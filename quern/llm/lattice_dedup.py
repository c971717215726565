"""Near-duplicate embeddings by lattice hashing.

In each of `tables`, a random projection maps unit vectors to eight dimensions, where the nearest point of
the E8 lattice is a vector's home cell; the `probes` neighbouring cells nearest to it (of the 240 that
touch it) are probed too. A vector meets the vectors at home in its home and probed cells. With cells of
width 0.6, six tables and four probes, 98 % of pairs with cosine exactly 0.9 meet at least once, and more of
closer ones.

1. Vectors alike in every component are one class with a number of copies.
2. In every occupied cell, blocks of those at home are held against blocks of all that visit, cosines in
   double precision, and a spanning forest of the links found goes on: at most one edge a visitor.
3. Components of these edges are then searched in full, block by block, for the number of links of each
   class: a pair that meets in several cells counts once, as does one that met in none.

So what is written grows with the vectors, never with the pairs; a hot cell or component is cut into pairs of
blocks and no group is held whole.

Nulls and oddities: a vector that is null, zero or empty, or holds a null or non-finite component, links with nothing, is
its own component and is kept. Vectors of different lengths don't link. Rows that repeat an id are rows of
their own. A null id can't name a component; the least that isn't null does. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.components import components
from quern.functions.shared import cut
from quern.functions.batches import groups
from quern.functions.textvec import mix
from quern.llm.vectors import matrix, units, whole

HOME_BLOCK, VISIT_BLOCK, PAIR_BLOCK = 1024, 4096, 256


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integer points with an even sum, and those moved by 1/2 throughout."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=1)
def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors: from a cell's centre to those of the cells that touch it."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@lru_cache(maxsize=64)
def _projection(length: int, table: int, width: float, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length, table]).normal(size=(length, 8)) / np.sqrt(8) / width


def _name(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point."""
    out = np.zeros(len(points), np.uint64)
    for k in range(8):
        out = mix(out + (2 * points[:, k]).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def cells(unit: np.ndarray, table: int, width: float, probes: int, seed: int) -> np.ndarray:
    """(rows, 1 + probes) names: the home cell, then the probed ones by distance."""
    y = unit @ _projection(unit.shape[1], table, width, seed)
    home = nearest_e8(y)
    names = [_name(home)]
    if probes:
        steps = shortest_e8()
        # |rest - step|^2 = |rest|^2 - 2 rest.step + 2: nearest are those with the largest product
        order = np.argpartition(-((y - home) @ steps.T), probes - 1, axis=1)[:, :probes]
        names += [_name(home + steps[order[:, k]]) for k in range(probes)]
    return np.stack(names, 1)


_VISITS = pa.schema([("size", pa.int32()), ("table", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("c", pa.int64())])


def _visits(tables: int, width: float, probes: int, seed: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                for a in range(0, len(rows), 2048):
                    part = rows.slice(a, 2048)
                    unit, c = units(matrix(part.column("vector"), kind)), part.column("c").to_numpy()
                    for t in range(tables):
                        names = cells(unit, t, width, probes, seed)
                        n, k = names.shape
                        home = np.zeros((n, k), bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * k, size, np.int32)), pa.array(np.full(n * k, t, np.int32)), pa.array(names.ravel()), pa.array(home.ravel()), pa.array(np.repeat(c, k))], schema=_VISITS)

    return run


def _forest(least: float, kind):
    """For each block of those at home and of visitors: edges from each linked class to the least it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for group in groups(batches, ["size", "table", "cell", "i", "j"]):
            side, c = group.column("side").to_numpy(), group.column("c").to_numpy()
            if not (side == 0).any() or not (side == 1).any():
                continue
            unit = units(matrix(group.column("vector"), kind))
            hc, vc = c[side == 0], c[side == 1]
            near = unit[side == 0] @ unit[side == 1].T >= least
            rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            near, hc, vc = near[np.ix_(rows, columns)], hc[rows], vc[columns]
            if not len(hc) or (len(hc) == 1 and len(vc) == 1 and hc[0] == vc[0]):
                continue
            top = np.iinfo(np.int64).max
            left, right = hc, vc
            while True:
                new_left = np.minimum(left, np.where(near, right[None, :], top).min(1))
                new_right = np.minimum(right, np.where(near, new_left[:, None], top).min(0))
                if (new_left == left).all() and (new_right == right).all():
                    break
                left, right = new_left, new_right
            u, v = np.concatenate([hc, vc]), np.concatenate([left, right])
            us.append(u[u != v])
            vs.append(v[u != v])
            held += len(u)
            if held > 50_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})
                us, vs, held = [], [], 0
        if us:
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return run


def _count(least: float, kind):
    """For each pair of blocks of a component: the copies that each class links with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["component", "i", "j"]):
            side, c, m = (group.column(k).to_numpy() for k in ("side", "c", "m"))
            unit = units(matrix(group.column("vector"), kind))
            a, b = side == 0, side == 1
            if not a.any() or not b.any():
                continue
            near = unit[a] @ unit[b].T >= least
            near &= c[a][:, None] != c[b][None, :]
            out_c, out_n = [c[a]], [near @ m[b]]
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                out_c.append(c[b])
                out_n.append(m[a] @ near)
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.concatenate(out_c)), "links": pa.array(np.concatenate(out_n).astype(np.int64))})

    return run


def link_vectors(rows: DataFrame, least: float = 0.9, tables: int = 6, width: float = 0.6, probes: int = 4, seed: int = 7, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of `rows`: id, n_links, component_id, kept.

    n_links counts the other rows at cosine `least` or more that were found, component_id is the least id
    that links reach, and `kept` says that it is the row's own.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind, packing = (np.float32, "float") if element == "float" else (np.float64, "double")
    held = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(f"array<{packing}>").alias("vector"))
    sound = whole(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    held = held.withColumn("c", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("vector")))
    classes = held.where("c is not null").groupBy("c").agg(F.first("vector").alias("vector"), F.count("*").alias("m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
            cuts = np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("m"), vectors.value_lengths().cast(pa.int32()), pa.array([flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=pa.schema([("c", pa.int64()), ("m", pa.int64()), ("size", pa.int32()), ("vector", pa.binary())]))

    classes = cut(classes.mapInArrow(pack, "c long, m long, size int, vector binary"), "vectors")
    visits = cut(classes.repartition(partitions).mapInArrow(_visits(tables, width, probes, seed, kind), "size int, table int, cell long, home boolean, c long"), "visits")
    key = ["size", "table", "cell"]
    used = visits.groupBy(*key).agg(F.count_if("home").alias("h"), F.count("*").alias("n")).where("h > 0 and n > 1")
    used = used.select(*key, F.ceil(F.col("h") / HOME_BLOCK).alias("hs"), F.ceil(F.col("n") / VISIT_BLOCK).alias("vs"))
    visits = visits.join(used, key)
    home = visits.where("home").select(*key, F.expr("pmod(xxhash64(c), hs)").alias("i"), F.explode(F.expr("sequence(0L, vs - 1)")).alias("j"), F.lit(0).alias("side"), "c")
    visit = visits.select(*key, F.explode(F.expr("sequence(0L, hs - 1)")).alias("i"), F.expr("pmod(xxhash64(c, 1), vs)").alias("j"), F.lit(1).alias("side"), "c")
    met = home.unionByName(visit).join(classes.select("c", "vector"), "c")
    place = [*key, "i", "j"]
    edges = met.repartition(partitions, *place).sortWithinPartitions(*place).mapInArrow(_forest(least, kind), "u long, v long")
    found = cut(components(edges), "components")

    inside = found.withColumnRenamed("node", "c").join(classes.select("c", "m", "vector"), "c")
    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks"))
    inside = inside.join(blocks, "component").withColumn("own", F.expr("pmod(xxhash64(c, 2), blocks)"))
    one = inside.select("component", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), F.lit(0).alias("side"), "c", "m", "vector")
    two = inside.select("component", F.explode(F.expr("sequence(0L, own)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "c", "m", "vector")
    counted = one.unionByName(two).repartition(partitions, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_count(least, kind), "c long, links long")
    counted = counted.groupBy("c").agg(F.sum("links").alias("links"))

    about = classes.select("c", "m").join(found.withColumnRenamed("node", "c"), "c", "left").join(counted, "c", "left")
    about = about.select("c", F.coalesce("component", "c").alias("component"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = held.select("id", "c").join(about, "c", "left")
    least_ids = out.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = out.join(least_ids, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
