"""Jaccard self-join of word n-gram sets by vertical partitioning.

Each text is the set of its distinct n-grams, held as 64-bit hashes. The global order of n-grams
is that of their hashes; it is cut into fragments of equal width, so the pivots need no
statistics. What a fragment finds is partial and is summed: per document in the filter, per pair
in the verification.

1. Every document's set is cut at the pivots; the segments of a batch travel together, one packed
   row for each fragment. Texts with equal sets are one class from here on.
2. A fragment counts in how many classes each of its n-grams lies, and reports those with two or
   more to the class. An n-gram that many classes of one piece of input share is known to be shared
   there: its occurrences go to their classes directly, and its fragment gets one mark. So an n-gram
   of a third of all texts isn't gathered. Summed over fragments, a class has the number of its shared n-grams. A
   partner with Jaccard >= t shares at least ceil(t * n) of n, so classes with fewer shared ones
   are finished: most of them, as prose shares little.
3. Those left list their shared n-grams rarest first, marked ones last; two linked classes have an n-gram in common
   among the first (shared - ceil(t * n) + 1). Lists of that prefix join to stars, whose
   components are families: a link never leaves a family.
4. In a family, the class with the commonest n-grams leads. Partial overlaps of every class with
   its leader are counted by fragment and summed per pair.
5. Classes that don't reach their leader are held against all of their family, in pairs of blocks, and
   give the edges of a spanning forest. So the rows made grow with the classes, not with the
   pairs of a family. A pair of blocks cuts the order of its n-grams into fragments too and sums the
   partial overlaps of each pair.

Where the number of links is asked for, step 5 takes all classes of a family in place of step 4, and each pair of
blocks sends on a class's links as one number. So links are counted, not listed; work, though not rows, grows with the
square of a family's classes.

Exactness: overlaps are exact up to collisions of 62-bit hashes (about 1e-9 for 1e5 documents of
500 words). Every step is complete: nothing is capped or sampled.

Nulls and oddities: a null or blank text has an empty set and links with nothing. Rows that
repeat an id are rows of their own. A null id can't name a component; a component is named by
the least id in it that isn't null, a component without one has a null name. A very long text is read
whole, as a piece of its own. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.components import components
from quern.functions.shared import cut
from quern.functions.batches import pieces
from quern.functions.textvec import among, common_values, mix, shingle_sets

_PACKED = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("cs", pa.binary()), ("lens", pa.binary()), ("ss", pa.binary())])
_PACKED_SQL = "kind int, place int, id long, n long, c long, cs binary, lens binary, ss binary"
_SETS_SQL = "kind int, id long, n long, c long, weight double, shared binary, prefix array<long>"
_SETS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("weight", pa.float64()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))])
DOC, SEGMENTS, CANDIDATE, DIRECT, MARK, SIZE = range(6)
#: Classes of one piece that share an n-gram and so know it to be shared, without asking its fragment.
HOT = 32
#: Classes of a block in step 5, of those without a link to their leader and of all; and a block's n-grams.
REST, BLOCK, GRAMS = 256, 1024, 1 << 20
#: N-grams of a fragment in step 5, and pairs with one of them that are listed at once.
WIDTH, LISTED = 4096, 1 << 21
#: Bytes of text treated at once.
PIECE = 4 << 20
#: Classes that share a leader's segment in one group of step 4.
SPREAD = 4096


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _seven(x: np.ndarray) -> bytes:
    """The low seven bytes of each number; the row's place in the order has the high ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(data: bytes, place: int, bits: int) -> np.ndarray:
    x = np.zeros((len(data) // 7, 8), np.uint8)
    x[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return x.view(np.uint64).ravel() | (np.uint64(place) << np.uint64(64 - bits))


def class_key(x: np.ndarray) -> int:
    """The 64-bit name of a set of hashes, signed."""
    return int((mix(x.sum(keepdims=True) + np.uint64(len(x))) if len(x) else np.zeros(1, np.uint64)).view(np.int64)[0])


def _direct(x: np.ndarray, c: np.ndarray, hot: np.ndarray, bits: int) -> list[tuple]:
    """A mark for each hot n-gram's fragment, and their occurrences packed by the classes' places."""
    marks = (hot >> np.uint64(64 - bits)).astype(np.int64)
    rows = [(MARK, p, None, None, None, None, None, _seven(hot[a:b])) for p, a, b in _grouped(marks)]
    use = among(x, hot)
    x, c = x[use], c[use]
    to = c & ((1 << bits) - 1)
    order = np.argsort(to, kind="stable")
    x, c = x[order], c[order]
    return rows + [(DIRECT, q, -1, None, None, c[a:b].tobytes(), np.full(b - a, 65535, np.uint16).tobytes(), x[a:b].tobytes()) for q, a, b in _grouped(to[order])]


def _grouped(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted key: (key, from, to)."""
    at = _runs(key)
    yield from zip(key[at].tolist(), at.tolist(), [*at[1:].tolist(), len(key)], strict=True)


def _segments(size: int, bits: int):
    clear = ~np.uint64((1 << 64 - bits) - (1 << 56)) if bits < 8 else ~np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                sets = shingle_sets(part.column("text"), size)
                keys = [class_key(x) for x in sets]
                sizes = [len(x) for x in sets]
                # Rows are dealt round; a class's place hears of its size once a piece, however many copies there are.
                yield _rows(_PACKED, [(DOC, j & ((1 << bits) - 1), i, n, k, None, None, None) for j, (i, n, k) in enumerate(zip(part.column("id").to_pylist(), sizes, keys, strict=True))])
                once = {k: j for j, (k, n) in enumerate(zip(keys, sizes, strict=True)) if n}
                if not once:
                    continue
                yield _rows(_PACKED, [(SIZE, k & ((1 << bits) - 1), None, sizes[j], k, None, None, None) for k, j in once.items()])
                c = np.fromiter(once.keys(), np.int64, len(once))
                x = np.concatenate([sets[j] for j in once.values()]) & clear
                d = np.repeat(np.arange(len(c)), [sizes[j] for j in once.values()])
                hot = common_values(x, HOT)
                if len(hot):
                    yield _rows(_PACKED, _direct(x, c[d], hot, bits))
                    cold = ~among(x, hot)
                    x, d = x[cold], d[cold]
                place = (x >> np.uint64(64 - bits)).astype(np.uint16)
                order = np.argsort(place, kind="stable")
                x, d, edges = x[order], d[order], np.searchsorted(place[order], np.arange((1 << bits) + 1))
                rows = []
                for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if b > a:
                        own = d[a:b]
                        at = _runs(own)
                        rows.append((SEGMENTS, p, None, None, None, c[own[at]].tobytes(), np.diff(np.r_[at, b - a]).astype(np.uint32).tobytes(), _seven(x[a:b])))
                yield _rows(_PACKED, rows)

    return run


def _shared(bits: int):
    """In each fragment: n-grams that lie in two classes or more, sent on to the classes' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        marked: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            through = batch.filter(pa.array((kinds == DOC) | (kinds == DIRECT) | (kinds == SIZE)))
            if len(through):
                yield through
            for p, ss in zip(*(x.to_pylist() for x in batch.filter(pa.array(kinds == MARK)).select(["place", "ss"]).columns), strict=True):
                marked.setdefault(p, []).append(_eight(ss, p, bits))
            for p, cs, lens, ss in zip(*(x.to_pylist() for x in batch.filter(pa.array(kinds == SEGMENTS)).select(["place", "cs", "lens", "ss"]).columns), strict=True):
                held.setdefault(p, []).append((np.repeat(np.frombuffer(cs, np.int64), np.frombuffer(lens, np.uint32)), _eight(ss, p, bits)))
        for p in list(held):
            got = held.pop(p)
            c, x = (np.concatenate(y) for y in zip(*got, strict=True))
            del got
            order = np.argsort(x)
            x, c = x[order], c[order]
            same = np.zeros(len(x), bool)
            np.equal(x[1:], x[:-1], out=same[1:])
            same[:-1] |= same[1:]
            if p in marked:
                same |= among(x, np.unique(np.concatenate(marked[p])))
            x, c = x[same], c[same]
            order = np.lexsort((c, x))
            x, c = x[order], c[order]
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:] != x[:-1]) | (c[1:] != c[:-1])
            x, c = x[fresh], c[fresh]
            at = _runs(x)
            df = np.diff(np.r_[at, len(x)])
            df = np.repeat(df, df)
            hot = among(x, np.unique(np.concatenate(marked[p]))) if p in marked else np.zeros(len(x), bool)
            keep = (df > 1) | hot
            x, c, df = x[keep], c[keep], np.where(hot[keep], 65535, np.minimum(df[keep], 65534)).astype(np.uint16)
            to = (c & ((1 << bits) - 1)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            x, c, df, edges = x[order], c[order], df[order], np.searchsorted(to[order], np.arange((1 << bits) + 1))
            rows = [(SEGMENTS, q, p, None, None, c[a:b].tobytes(), df[a:b].tobytes(), _seven(x[a:b])) for q, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
            if rows:
                yield _rows(_PACKED, rows)

    return run


def _candidates(percent: int, bits: int):
    """At each class: the number of its shared n-grams against what a partner would share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size: dict[int, int] = {}
        got = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            docs = batch.filter(pa.array(kinds == DOC))
            told = batch.filter(pa.array(kinds == SIZE))
            size.update(zip(told.column("c").to_pylist(), told.column("n").to_pylist(), strict=True))
            if len(docs):
                yield pa.RecordBatch.from_arrays([docs.column("kind"), docs.column("id"), docs.column("n"), docs.column("c"), *(pa.nulls(len(docs), t.type) for t in list(_SETS)[4:])], schema=_SETS)
            for p, cs, df, ss in zip(*(x.to_pylist() for x in batch.filter(pa.array((kinds == SEGMENTS) | (kinds == DIRECT))).select(["id", "cs", "lens", "ss"]).columns), strict=True):
                got.append((np.frombuffer(cs, np.int64), np.frombuffer(ss, np.uint64) if p < 0 else _eight(ss, p, bits), np.frombuffer(df, np.uint16)))
        if not got:
            return
        c, x, df = (np.concatenate(y) for y in zip(*got, strict=True))
        names, which = np.unique(c, return_inverse=True)
        # A class whose copies lie in several pieces hears of a marked n-gram from each.
        order = np.lexsort((x, which))
        c, x, df, which = c[order], x[order], df[order], which[order]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (x[1:] != x[:-1])
        c, x, df, which = c[fresh], x[fresh], df[fresh], which[fresh]
        count = np.bincount(which, minlength=len(names))
        n = np.array([size[k] for k in names.tolist()])
        least = -(-percent * n // 100)
        keep = (count >= least)[which]
        c, x, df, which = c[keep], x[keep], df[keep], which[keep]
        order = np.lexsort((x, df, which))
        c, x, df, which = c[order], x[order], df[order], which[order]
        rows, at = [], np.r_[_runs(which), len(which)].tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            k = which[a]
            rows.append((CANDIDATE, None, int(n[k]), int(names[k]), float(df[a:b].mean(dtype=np.float64)), np.sort(x[a:b]).tobytes(), x[a : a + b - a - int(least[k]) + 1].view(np.int64)))
            if len(rows) >= 256:
                yield _rows(_SETS, rows)
                rows = []
        if rows:
            yield _rows(_SETS, rows)

    return run


def _cut_sets(bits: int):
    """(family, part, place, lead, c, n, segment) for each fragment that has a segment of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for family, part, lead, c, n, shared in zip(*(batch.column(k).to_pylist() for k in ("family", "part", "lead", "c", "n", "shared")), strict=True):
                x = np.frombuffer(shared, np.uint64)
                edges = np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                rows += [(family, part, p, lead, c, n, x[a:b].tobytes()) for p, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True))]
            if rows:
                yield _rows(_CUT, rows)

    return run


_CUT = pa.schema([("family", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("lead", pa.bool_()), ("c", pa.int64()), ("n", pa.int64()), ("segment", pa.binary())])
_CUT_SQL = "family long, part long, place int, lead boolean, c long, n long, segment binary"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps with the leader, whose segment comes first in its group."""
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("leader", pa.int64()), ("leader_n", pa.int64()), ("common", pa.int64())])
    group, leader, leader_n, own = None, None, None, None
    for batch in batches:
        rows = []
        for family, part, place, lead, c, n, segment in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            x = np.frombuffer(segment, np.uint64)
            if lead:
                group, leader, leader_n, own = (family, part, place), c, n, x
                continue
            assert group == (family, part, place)
            at = np.searchsorted(own, x)
            at[at == len(own)] = 0
            rows.append((c, n, leader, leader_n, int((own[at] == x).sum()) if len(own) else 0))
        if rows:
            yield _rows(schema, rows)


def linked(common, n, m, percent: int):
    """Jaccard of sets of n and m with so much in common reaches the threshold."""
    return 100 * common >= percent * (n + m - common)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams in order, and the set that each is of."""
    x, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(y) for y in sets])
    order = np.argsort(x, kind="stable")
    return x[order], of[order]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one: partial ones by fragment, summed per pair.

    In a fragment, n-grams of many pairs are counted by a product of 0-1 matrices; pairs of others are listed and counted.
    """
    (x, r), (y, c) = _flat(left), _flat(right)
    both = np.intersect1d(x, y)
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(both), WIDTH):
        grams = both[at : at + WIDTH]
        start, end = np.searchsorted(x, grams), np.searchsorted(x, grams, "right")
        start2, end2 = np.searchsorted(y, grams), np.searchsorted(y, grams, "right")
        n, m = end - start, end2 - start2
        many = n * m * 64 > common.size
        if many.any():
            one, two = np.zeros((len(left), int(many.sum())), np.float32), np.zeros((len(right), int(many.sum())), np.float32)
            one[r[_ranges(start[many], n[many])], np.repeat(np.arange(one.shape[1]), n[many])] = 1
            two[c[_ranges(start2[many], m[many])], np.repeat(np.arange(two.shape[1]), m[many])] = 1
            common += (one @ two.T).astype(np.int64)
        few = np.flatnonzero(~many)
        upto = np.cumsum(n[few] * m[few])
        while len(few):
            take = max(int(np.searchsorted(upto, LISTED, "right")), 1)
            some, m_of = few[:take], np.repeat(m[few[:take]], n[few[:take]])
            rows = r[_ranges(start[some], n[some])]
            columns = c[_ranges(np.repeat(start2[some], n[some]), m_of)]
            common += np.bincount(np.repeat(rows, m_of) * len(right) + columns, minlength=common.size).reshape(common.shape)
            few, upto = few[take:], upto[take:] - upto[take - 1]
    return common


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, `length` numbers for each."""
    return np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of a spanning forest of a bipartite graph."""
    edges: list[tuple[int, int]] = []
    rows, columns = links.any(axis=1), np.ones(links.shape[1], bool)  # not reached yet
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first] = False
        todo = [(int(first), True)]
        while todo:
            k, is_row = todo.pop()
            new = np.flatnonzero(links[k] & columns if is_row else links[:, k] & rows).tolist()
            (columns if is_row else rows)[new] = False
            edges += [(k, j) if is_row else (j, k) for j in new]
            todo += [(j, not is_row) for j in new]
    return edges


_LINKS_SQL = "u long, v long, links long"


def _links(percent: int):
    """Links of side 0 with side 1: as a spanning forest, and their number for each class, copies counted.

    Both sides of a pair of different blocks hear of their number; in a block with itself, or with i and j not
    numbering the same blocks, side 0 does.
    """

    def run(table: pa.Table) -> pa.Table:
        side, c, n, copies = (table.column(k).to_numpy() for k in ("side", "c", "n", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u, v, count = [], [], []
        if len(one) and len(two):
            found = linked(overlaps([sets[k] for k in one], [sets[k] for k in two]), n[one][:, None], n[two], percent) & (c[one][:, None] != c[two])
            edges = spanning(found)
            u, v, count = [int(c[one[a]]) for a, _ in edges], [int(c[two[b]]) for _, b in edges], [None] * len(edges)
            told = [(one, found @ copies[two])]
            if table.column("i")[0].as_py() != table.column("j")[0].as_py():
                told.append((two, copies[one] @ found))
            for who, number in told:
                some = number > 0
                u += c[who][some].tolist()
                v += [None] * int(some.sum())
                count += number[some].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(count, pa.int64())})

    return run


def _fragments(spark) -> int:
    """Bits of a fragment's number: two fragments or so for each shuffle partition, 64 at least."""
    return min(16, max(6, int(spark.conf.get("spark.sql.shuffle.partitions", "200")).bit_length()))


def _members(docs: DataFrame, percent: int, size: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 3: (id, n, c) of each row, and the classes that may have links, with their family."""
    bits = _fragments(docs.sparkSession)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    packed = docs.mapInArrow(_segments(size, bits), _PACKED_SQL)
    shared = packed.repartitionById(1 << bits, F.col("place")).mapInArrow(_shared(bits), _PACKED_SQL)
    sets = cut(shared.repartitionById(1 << bits, F.col("place")).mapInArrow(_candidates(percent, bits), _SETS_SQL), "sets")
    rows, cands = sets.where(f"kind = {DOC}").select("id", "n", "c"), sets.where(f"kind = {CANDIDATE}")

    posted = cands.select("c", F.explode("prefix").alias("gram"))
    least = posted.groupBy("gram").agg(F.min("c").alias("v"))
    families = components(posted.join(least, "gram").select(F.col("c").alias("u"), "v").where("u <> v").distinct())
    members = cands.join(families.withColumnRenamed("node", "c"), "c").select(F.col("component").alias("family"), "c", "n", "weight", "shared")
    return rows, cut(members, "members")


def _leader_links(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): steps 4 and 5, edges that join the classes which links join."""
    heads = members.groupBy("family").agg(F.max_by("c", F.struct("weight", "c")).alias("leader"), F.count("*").alias("members"))
    heads = heads.withColumn("parts", F.ceil(F.col("members") / SPREAD))

    led = members.join(heads, "family").withColumn("lead", F.expr("c = leader"))
    led = led.withColumn("part", F.explode(F.expr("if(lead, sequence(0L, parts - 1), array(pmod(xxhash64(c), parts)))")))
    pieces_ = led.select("family", "part", "lead", "c", "n", "shared").mapInArrow(_cut_sets(3), _CUT_SQL)
    counted = pieces_.repartition("family", "part", "place").sortWithinPartitions("family", "part", "place", F.desc("lead")).mapInArrow(_overlaps, "c long, n long, leader long, leader_n long, common long")
    near = counted.groupBy("c", "n", "leader", "leader_n").agg(F.sum("common").alias("common")).where(linked(F.col("common"), F.col("n"), F.col("leader_n"), percent))
    near = cut(near.select("c", "leader"), "near")

    # Only names and flags meet by family; the sets join by class, and only those of families with unattached classes.
    state = members.select("family", "c", "n").join(near, "c", "left").join(heads.select("family", F.col("leader").alias("head")), "family")
    state = state.select("family", "c", "n", F.coalesce("leader", "c").alias("near"), F.expr("leader is null and c <> head").alias("rest")).where("c <> near or rest")
    plan = state.groupBy("family").agg(F.count_if("rest").alias("r"), F.count("*").alias("m"), F.sum("n").alias("grams")).where("r > 0 and m > 1")
    plan = plan.select("family", F.ceil(F.col("r") / REST).alias("rs"), F.ceil(F.greatest(F.col("m") / BLOCK, F.col("grams") / GRAMS)).alias("ms"))
    state = state.join(plan, "family").withColumn("copies", F.lit(1).cast("long"))
    one = state.where("rest").select("family", F.expr("pmod(xxhash64(c), rs)").alias("i"), F.explode(F.expr("sequence(0L, ms - 1)")).alias("j"), F.lit(0).alias("side"), "c", "n", "copies")
    two = state.select("family", F.explode(F.expr("sequence(0L, rs - 1)")).alias("i"), F.expr("pmod(xxhash64(c, 1), ms)").alias("j"), F.lit(1).alias("side"), "c", "n", "copies")
    forest = one.unionByName(two).join(members.select("c", "shared"), "c").groupBy("family", "i", "j").applyInArrow(_links(percent), _LINKS_SQL)
    return near.select(F.col("c").alias("u"), F.col("leader").alias("v")).unionByName(forest.where("v is not null").select("u", "v"))


def _all_links(members: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(u, v, links): edges as before, and with v null the number of links of class u in one pair of blocks."""
    plan = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1")
    plan = plan.select("family", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("grams") / GRAMS)).alias("ms"))
    own = members.select("family", "c", "n", "shared").join(copies, "c").join(plan, "family").withColumn("own", F.expr("pmod(xxhash64(c), ms)"))
    sent = own.withColumn("to", F.explode(F.expr("concat(transform(sequence(0L, ms - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, if(x < own, 1, 0) AS side)), array(struct(own AS i, own AS j, 1 AS side)))")))
    return cut(sent.select("family", "to.*", "c", "n", "copies", "shared").groupBy("family", "i", "j").applyInArrow(_links(percent), _LINKS_SQL), "links")


def ngram_classes(docs: DataFrame, percent: int = 75, size: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, c, component) of each row; component: null for an empty set, else its links' least class.

    The class c names the set of n-grams; n is the set's size.
    """
    rows, members = _members(docs, percent, size, id, text)
    found = components(_leader_links(members, percent)).withColumnRenamed("node", "c")
    return rows.join(found, "c", "left").select("id", "n", "c", F.when(F.col("n") > 0, F.coalesce("component", "c")).alias("component"))


def ngram_components(docs: DataFrame, percent: int = 75, size: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, n_links.

    component_id is the least id among the rows that links reach, the row itself included; links
    join sets whose Jaccard similarity is at least percent / 100. n_links is the number of other rows that a link joins
    to the row, copies among them. See the module for nulls.
    """
    rows, members = _members(docs, percent, size, id, text)
    copies = rows.where("n > 0").groupBy("c").agg(F.count("*").alias("copies"))
    links = _all_links(members, copies, percent)
    found = components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "c")
    number = links.where("v is null").groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("links"))
    classes = copies.join(found, "c", "left").join(number, "c", "left")
    classes = classes.select("c", F.coalesce("component", "c").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = rows.join(classes, "c", "left")
    named = found.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = found.join(named, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the least id, null last.

    Rows without words are linked with nothing and all stay. Of rows alike in id and text one stays.
    """
    row = F.xxhash64(F.col(id), F.col(text))
    found = ngram_classes(docs.select(row.alias("row"), F.col(text).alias("text")), percent, size, "row", "text").select(F.col("id").alias("row"), "n", F.coalesce("component", "id").alias("component")).distinct()
    named = docs.select(row.alias("row"), F.col(id).cast("long").alias("named")).distinct().join(found, "row")
    least = F.struct(F.coalesce("named", F.lit((1 << 63) - 1)).alias("id"), "row", "n")
    stay = named.groupBy("component").agg(F.min(least).alias("least")).select("least.row", "least.n").unionByName(named.where("n = 0").select("row", "n")).distinct()
    # The input's columns travel as one struct, so none of their names meets one of these.
    whole = docs.select(row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    again = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    kept = whole.join(stay, "row").withColumn("again", again).where("again = 1 or n = 0")
    return kept.select("whole.*")
