"""Word hashing, the n-gram join and the suffix dedup against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.functions import textvec
from quern.llm import ngram_join, suffix_dedup, suffix_sort

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


TEXTS = ["", None, " \t\n", "one", "ONE  two", "a b c d e", "a b c d e a b c d e f", "é É ß ẞ x\u00a0y z", "x" * 5000 + " y", "a b c d e\x0bf g", "w " * 300]


def test_words_and_sets():
    column = pa.array(TEXTS)
    hashes, first = textvec.word_hashes(column)
    seen = {}
    for text, a, b in zip(TEXTS, first[:-1], first[1:], strict=True):
        own = words(text)
        assert b - a == len(own)
        for w, h in zip(own, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in textvec.shingle_sets(column)] == [len(shingles(t)) for t in TEXTS]
    assert [len(s) for s in textvec.shingle_sets(pa.chunked_array([column.slice(2, 5)]))] == [len(shingles(t)) for t in TEXTS[2:7]]


def brute_links(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    return [sum(bool(b) and k != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for k, a in enumerate(sets)]


def brute_components(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    out, links = [], brute_links(docs, percent)
    for k, (i, _) in enumerate(docs):
        ids = [j for m, (j, _) in enumerate(docs) if root(m) == root(k) and j is not None]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] else i, links[k]))
    return sorted(out, key=repr)


def components_of(docs, percent=75):
    """Sets of places that links join, of documents with words."""
    sets = [shingles(t) for _, t in docs]
    left, out = {k for k, x in enumerate(sets) if x}, []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            k = todo.pop()
            seen.add(k)
            near = {j for j in left if 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j])}
            left -= near
            todo += near
        out.append(seen)
    return out


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(30)}"
    return " ".join(w)


def made_docs(seed, n=120):
    rng = random.Random(seed)
    bases = [[f"b{k}_{j}" for j in range(rng.randint(6, 80))] for k in range(4)]
    common = [f"c{j}" for j in range(30)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            text = edited(rng, bases[rng.randrange(4)], rng.randint(0, 5))
        elif kind < 0.8:
            text = " ".join(common + [f"u{i}_{j}" for j in range(rng.randint(1, 40))])
        else:
            text = rng.choice(TEXTS)
        docs.append((i * 7 % 1000, text))
    return docs + docs[:3] + [(None, docs[0][1]), (None, None), (None, "lonely words stand here alone")]


@pytest.mark.parametrize("seed,rest,block,spread,hot", [(1, 256, 512, 4096, 32), (2, 3, 4, 5, 2), (3, 256, 512, 4096, 3)])
def test_join_against_pairs(spark, rows, monkeypatch, seed, rest, block, spread, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "REST", rest)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    docs = made_docs(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, n string, id long").repartition(3)
    assert rows(ngram_join.ngram_components(df), "doc_id", "n_shingles", "component_id", "n_links") == brute_components(docs)
    # The classes by way of leaders have the same components.
    got = [(r["n"], r["component"]) for r in ngram_join.ngram_classes(df).collect() if r["n"]]
    assert len({c for _, c in got}) == len(components_of(docs))


@pytest.mark.parametrize("width,listed", [(4096, 1 << 21), (7, 5)])
def test_overlaps_and_forest(monkeypatch, width, listed):
    monkeypatch.setattr(ngram_join, "WIDTH", width)
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    rng = np.random.default_rng(4)
    sets = [np.unique(np.r_[rng.integers(0, 60, 40), rng.integers(0, 5000, k)]).astype(np.uint64) for k in range(50)] + [np.zeros(0, np.uint64)]
    left, right = sets[:20] + sets[-1:], sets[15:]
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    assert (ngram_join.overlaps(left, right) == want).all()
    for share in (0.0, 0.02, 0.1, 0.9):
        links = rng.random((30, 40)) < share
        edges = ngram_join.spanning(links)
        assert all(links[a, b] for a, b in edges)
        up = list(range(70))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            assert root(a) != root(30 + b)  # a forest
            up[root(a)] = root(30 + b)
        assert all(root(a) == root(30 + b) for a, b in zip(*np.nonzero(links)))


def test_join_boundary(spark, rows):
    # 28 shared of 28 + 4 + 4 = 36 shingles are 77.8 %; of 38, 73.7 %
    a = [f"w{k}" for k in range(36)]
    close, far = " ".join(a[4:] + ["p", "q", "r", "s"]), " ".join(a[5:] + ["p", "q", "r", "s", "t"])
    for other in (close, far):
        docs = [(1, " ".join(a)), (2, other)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(ngram_join.ngram_components(df)) == brute_components(docs)


def test_join_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(df).count() == 0
    assert ngram_join.one_of_each(df).count() == 0


def test_one_of_each(spark, rows):
    base = " ".join(f"w{k}" for k in range(50))
    docs = [(5, base, "x"), (3, base + " more", "y"), (9, base, "z"), (3, base + " more", "y"), (None, base, "n"), (7, "", "e"), (8, "", "e"), (7, "", "e"), (1, "quite another text of its own", "o")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows(ngram_join.one_of_each(df), "doc_id", "source") == [(1, "o"), (3, "y"), (7, "e"), (7, "e"), (8, "e")]


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaa", b"abababab", b"mississippi", b"\x00\x00\x01\xff\x00", bytes(range(256)) * 2, b"the cat the cat the dog " * 20])
def test_suffix_array(data):
    x = np.frombuffer(data, np.uint8)
    got = suffix_sort.suffix_array(x, 64).tolist()
    assert sorted(got) == list(range(len(data)))
    key = [data[i : i + 64] for i in got]
    assert key == sorted(key)


def test_suffix_array_random():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 1), (50, 2), (500, 3), (3000, 4), (2000, 200)):
        x = rng.integers(0, letters, n).astype(np.uint8)
        data = x.tobytes()
        assert [data[i : i + 40] for i in suffix_sort.suffix_array(x, 40)] == sorted(data[i : i + 40] for i in range(n))


def brute_removal(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    count = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (i, _), b in zip(docs, texts, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_docs(seed, length):
    rng = random.Random(seed)
    letters = "abcdé "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randint(length - 3, 3 * length)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [make(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), make(rng.randint(0, length))]
        docs.append((i, "".join(parts)))
    docs += [(100, "a" * (4 * length)), (101, "ab" * (2 * length)), (102, None), (103, ""), (104, docs[0][1]), (0, docs[0][1]), (None, docs[1][1]), (None, None)]
    return docs


@pytest.mark.parametrize("length,heavy,seed,hot", [(200, 16384, 1, 64), (40, 16384, 2, 64), (40, 2, 3, 64), (16, 5, 4, 3), (200, 3, 5, 2), (40, 16384, 6, 2), (200, 16384, 7, 4)])
def test_removal_against_windows(spark, rows, monkeypatch, length, heavy, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = repeated_docs(seed, length)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, spans string, n_bytes int").repartition(3)
    got = suffix_dedup.remove_repeats(df, length, heavy=heavy, with_text=False)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(docs, length)


def test_removal_text_and_columns(spark, rows):
    passage = "é" * 120  # 240 bytes
    df = spark.createDataFrame([(1, "start " + passage + " end", "s1"), (2, passage, None), (3, "clean", "s3")], "doc_id long, text string, source string")
    got = suffix_dedup.remove_repeats(df, carry=("source",))
    assert rows(got, "doc_id", "text", "source") == [(1, "start  end", "s1"), (2, "", None), (3, "clean", "s3")]
    assert got.where("doc_id = 1").first()["spans"][0].asDict() == {"start": 6, "end": 246}
    assert suffix_dedup.whole_characters("é".encode()[1:] + b"a") == "a"
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 8)


def shared_passage(seed, n, passage, around):
    """Texts with one passage in common, whose edges differ in each."""
    rng = np.random.default_rng(seed)
    common = rng.integers(97, 101, passage).astype(np.uint8).tobytes().decode()
    own = lambda: rng.integers(97, 123, int(rng.integers(0, around))).astype(np.uint8).tobytes().decode()
    return [(k, own() + common + own()) for k in range(n)]


@pytest.mark.parametrize("crowd,held", [(32, 8 << 20), (2, 8 << 20), (1 << 30, 4000), (1 << 30, 8 << 20)])
def test_removal_of_a_common_passage(spark, rows, monkeypatch, crowd, held):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    docs = shared_passage(11, 300, 420, 90) + [(900, "ab" * 300), (901, None), (902, "ab" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(suffix_dedup.remove_repeats(df, 200, with_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(docs, 200)


def test_no_name_grows_with_the_texts():
    docs = shared_passage(5, 20_000, 1000, 60)
    batches = [pa.RecordBatch.from_pydict({"row": pa.array([k for k, _ in docs[a : a + 1000]], pa.int64()), "text": [t for _, t in docs[a : a + 1000]]}) for a in range(0, 20_000, 1000)]
    found, marked = {}, set()
    for batch in suffix_dedup._send_anchors(200, 64, 6)(iter(batches)):
        for kind, *fields, h in zip(*(batch.column(k).to_pylist() for k in ("kind", "row", "at", "low", "high", "anchor")), strict=True):
            if kind == suffix_dedup.MARK:
                marked.update(np.frombuffer(h, np.int64).tolist())
            else:
                for row, at, low, high, anchor in zip(*(np.frombuffer(x, t).tolist() for x, t in zip([*fields, h], (np.int64, np.int32, np.int16, np.int16, np.int64), strict=True)), strict=True):
                    found.setdefault(row, []).append((at, low, high, anchor))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int64()), ("many", pa.bool_())]))
    names = {}
    for batch in batches:
        asked = [[dict(zip(("at", "low", "high", "anchor", "many"), (*x, x[3] in marked), strict=True)) for x in found.get(row, ()) if x[3] in marked] for row in batch.column("row").to_pylist()]
        for sent in suffix_dedup._send_contexts(200)(iter([batch.append_column("found", pa.array(asked, kind))])):
            for name, k in zip(sent.column("name").to_pylist(), sent.column("kind").to_pylist(), strict=True):
                if k in (suffix_dedup.LONE, suffix_dedup.KNOWN, suffix_dedup.APART):
                    names[name] = names.get(name, 0) + 1
    assert marked and max(names.values()) < 32 * 40


@pytest.mark.parametrize("block", [1 << 19, 600, 250])
def test_names_with_more_than_a_block(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    core = b"the anchor of all of them"
    contexts, texts = [], []
    for row in range(60):
        left, right = (bytes(rng.choice([97, 98], int(rng.integers(8, 14))).astype(np.uint8)) for _ in range(2))
        texts.append(left + core + right)
        contexts.append((7, suffix_dedup.LONE, row, 0, len(left), texts[-1]))
    length = 30
    batch = suffix_dedup._batch(suffix_dedup._CONTEXT, contexts)
    got = {row: np.zeros(len(t), bool) for row, t in enumerate(texts)}
    for out in suffix_dedup._match(length)(iter([batch])):
        for row, spans in zip(out.column("row").to_pylist(), out.column("spans").to_pylist(), strict=True):
            for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2):
                got[row][a:b] = True
    where = {}
    for row, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            where.setdefault((t.index(core) - a, t[a : a + length]), []).append((row, a))
    want = {row: np.zeros(len(t), bool) for row, t in enumerate(texts)}
    for uses in where.values():
        if len(uses) > 1:
            for row, a in uses:
                want[row][a : a + length] = True
    assert any(w.any() for w in want.values()) and all((got[r] == want[r]).all() for r in want)
