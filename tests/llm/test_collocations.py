"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import collocations as co


def plain(docs, longest, least, covered, most):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        cands = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), found[p[:k]], found[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, phrase, a, l, r, n[lang], score) for i, (score, a, phrase, l, r) in enumerate(rows[:most])]
    return sorted(out)


def made(seed=1, docs=60):
    rng = random.Random(seed)
    words = "the THE of a\tb ü Ünder x's cat dog new york city 漢字 \U0001f600 l'été".split(" ")
    out = [(None, None), ("en", None), ("en", ""), (None, ".,;"), ("en", " \t. "), ("und", "und new york city new york city")]
    for _ in range(docs):
        text = "".join(rng.choice(["new york city", *words]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! "]) for _ in range(rng.randrange(120)))
        out.append((rng.choice(["en", "en", "en", "de", None, ""]), text))
    return out + out[-3:] * 2


@pytest.mark.parametrize("longest, least, bits", [(3, 10, 24), (3, 3, 6), (4, 4, 3), (2, 2, 16), (5, 2, 17)])
def test_against_plain(spark, rows, longest, least, bits):
    docs = made()
    df = spark.createDataFrame([(l, t, "x", 3) for l, t in docs], "lang string, text string, phrase string, f int").repartition(5)
    got = rows(co.collocations(df, longest, least, 50, 12, bits))
    assert sorted(got) == plain(docs, longest, least, 50, 12)


def test_empty_and_long(spark, rows, monkeypatch):
    df = spark.createDataFrame(made(2, 5), "lang string, text string")
    assert co.collocations(df.limit(0)).count() == 0
    text = "one two three, four five\n" * 4000 + "six " * 5000
    long = spark.createDataFrame([("en", text)], "lang string, text string")
    assert rows(co.collocations(long, most=20)) == plain([("en", text)], 3, 10, 50, 20)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    monkeypatch.setattr(co, "_MOST_BYTES", 1000)
    parts = [p.column("text")[0].as_py() for p in co._cut_long(batch)]
    assert "".join(parts) == text and len(parts) > 90 and all(p.endswith((",", "\n")) for p in parts[:-1])


def test_filters_lose_nothing():
    """Every frequent phrase passes the filters of its pass, however few the buckets."""
    words = co.Words(pa.array(["a b c. a b c, d a b"]), pa.array(["en"]))
    assert words.whole(3).tolist() == [True, False, False, True, False, False, True]
    counters = co.Counters(4, 3)
    counters.add(co._bucket(words.hashes(2)[words.whole(2)], 4))
    counters.add(np.array([3, 5]), np.array([200, 1]))
    assert counters.held.max() == 3 and counters.held[3] == 3
    assert [x.as_py() for x in words.phrases(np.array([0, 6]), 2)] == ["a b", "d a"]
