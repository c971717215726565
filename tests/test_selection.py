"""Selection of a corpus as a fixed point over sources, and the whole chain from conversations, against single passes."""

import hashlib
import os
import random

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.functions.vocabulary import token_counts
from quern.operators import chat, corpus, selection
from quern.plans import catalog
from tests.test_overlap_dedup import loop_fold


def test_conflicts_across_sources(spark):
    """Chains of refusals run through all sources: each source's choice depends on the one before."""
    rng = random.Random(7)
    rows, near = [], set()
    for k in range(6):
        for p in range(60):
            rows.append((f"s{k}", p, 100 * k + p, f"t{rng.randrange(120)}", rng.choice([None, rng.randrange(1, 9)]), rng.choice([None, rng.randrange(5, 30)])))
    for _ in range(150):
        a, b = sorted(rng.sample([r[2] for r in rows], 2))
        near.add((a, b))
    budgets = [(f"s{k}", rng.randrange(0, 60), rng.randrange(0, 200)) for k in range(6)]
    df = spark.createDataFrame(rows, "source string, place long, row_id long, identity string, short_tokens int, long_tokens int")
    pairs = spark.createDataFrame(sorted(near), "left_id long, right_id long")
    got = selection.select_corpus(df, pairs, [selection.Budget(*b) for b in budgets])
    assert sorted(tuple(r) for r in got.select("row_id", "bucket", "tokens").collect()) == loop_fold(rows, budgets, near)
    few = selection.select_corpus(df, pairs, [selection.Budget(*b) for b in budgets], most_examined=10)
    assert sorted(tuple(r) for r in few.select("row_id", "bucket", "tokens").collect()) == loop_fold([r for r in rows if r[1] < 10], budgets, near)
    assert selection.select_corpus(df.limit(0), pairs, [selection.Budget("s0", 1, 1)]).count() == 0


def test_examined(spark, rows):
    df = spark.createDataFrame([(k, None if k % 3 == 0 else f"s{k % 3}") for k in range(300)], "id long, source string")
    got = {(r["id"], r["place"]) for r in corpus.examined(df, 40, "id", ["source"]).collect()}
    key = lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k)
    assert got == {(k, p) for s in range(3) for p, k in enumerate(sorted(range(s, 300, 3), key=key)[:40])}


def test_vocabulary(spark):
    path = catalog.vocabulary()
    known = Tokenizer.from_file(path)
    data = [(["a b", "", None, "über\n\n"],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(data, "t array<string>").select(token_counts(F.col("t"), path)).collect()]
    assert got == [[len(known.encode(x or "", add_special_tokens=False).ids) for x in data[0][0]], None, []]


def one_pass(conversations, budgets, windows, path):
    """The chain as one loop: (conv, source, bucket, tokens, prefix length, digest of the rendered text)."""
    known = Tokenizer.from_file(path)
    seen, prompts, out = set(), [], []
    for source, short, long in budgets:
        spent, target = {"short": 0, "long": 0}, {"short": short, "long": long}
        own = [c for c in conversations if f"src{c % 4}" == source]
        for conv in sorted(own, key=lambda c: (hashlib.md5(f"42:{c}".encode()).hexdigest(), c)):
            if all(spent[b] >= target[b] for b in target):
                break
            messages = conversations[conv]
            if not messages or any(r not in ("system", "user", "assistant", "tool") for r, _ in messages):
                continue
            prompt = next((t or "" for r, t in messages if r == "user"), "")
            identity = f"{source}:{hashlib.sha256(prompt.encode()).hexdigest()}"
            w = regex.findall(r"[\p{L}\p{N}_]+", prompt.lower())
            grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if identity in seen or grams and any(100 * len(grams & g) >= 85 * len(grams | g) for g in prompts if g):
                continue
            found = {}
            for bucket, (low, high) in windows.items():
                if spent[bucket] >= target[bucket]:
                    continue
                view = [m for m in messages if m[0] != "system"] if bucket == "short" else messages
                for n in range(1, len(view) + 1):
                    if view[n - 1][0] != "assistant":
                        continue
                    text = "".join(f"<|{r}|>\n{t or ''}<|end|>\n" for r, t in view[:n])
                    size = len(known.encode(text, add_special_tokens=False).ids)
                    if size > high:
                        break
                    if size >= low:
                        found[bucket] = size, n, hashlib.sha256(text.encode()).hexdigest()
            if found:
                bucket = max(found, key=lambda b: (target[b] - spent[b]) / target[b])
                spent[bucket] += found[bucket][0]
                seen.add(identity)
                prompts.append(grams)
                out.append((conv, source, bucket, *found[bucket]))
    return sorted(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_chain_against_one_pass(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    turns = pd.read_parquet(f"{sf}/conversations.parquet").sort_values(["conv_id", "turn"])
    conversations = {c: list(zip(g["role"], g["text"], strict=True)) for c, g in turns.groupby("conv_id")}
    budgets = [(f"src{k}", 4000 + 1000 * k, 12000 - 1000 * k) for k in range(4)]
    got = catalog.chat_corpus_selection(spark, sf).select("conv_id", "source", "bucket", "tokens", "prefix_length", "rendered_sha256")
    want = one_pass(conversations, budgets, {"short": (128, 1024), "long": (768, 4096)}, catalog.vocabulary())
    assert sorted(tuple(r) for r in got.collect()) == want and {r[2] for r in want} == {"short", "long"}


def test_chain_with_tools_and_refusals(spark):
    """Tool calls keep their results, refused rows and unlicensed sources go, equal tasks are taken once."""
    call = lambda i: [(i, "function", ("shell", '{"cmd": "ls"}'))]
    say = lambda role, text, calls=None, id=None, old=None: (role, text, calls, id, None, old, None, None)
    long = "word " * 60
    rows = [
        (1, "src0", "t1", [say("system", "Rules."), say("user", "list files " + long), say("assistant", "", call("a")), say("tool", "out", None, "a"), say("assistant", "done")], '[{"name": "shell"}]'),
        (2, "src0", "t1", [say("user", "another prompt here"), say("assistant", long)], None),  # its task is taken
        (3, "src0", None, [say("user", "x"), say("assistant", long, None, None, "legacy")], None),  # refused
        (4, "src0", None, [say("user", "orphan"), say("tool", long, None, "z")], None),  # no coherent prefix
        (5, "other", None, [say("user", "u"), say("assistant", long)], None),
        (6, "src0", "", [say("user", "six " + long), say("assistant", "", call("b"))], None),  # the call is unanswered
        (7, "src0", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, source string, trajectory string, messages {chat.RAW_MESSAGES}, tools string")
    count = lambda texts: F.transform(texts, lambda t: corpus.token_count(t))
    found = selection.chat_selection(df, [selection.Budget("src0", 100, 100)], count, {"short": (20, 1000), "long": (20, 1000)}, tasks=("trajectory",), tools="tools").collect()
    kept = {r["conv_id"]: r for r in found}
    order = sorted((1, 2), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert set(kept) == {order[0]} and kept[order[0]]["task"] == "src0:t1" and kept[order[0]]["bucket"] == "short"
    both = selection.chat_selection(df.where("conv_id <> 2"), [selection.Budget("src0", 0, 100)], count, {"short": (20, 1000), "long": (20, 1000)}, tasks=("trajectory",), tools="tools").collect()
    assert [r["conv_id"] for r in both] == [1] and both[0]["bucket"] == "long" and both[0]["prefix_length"] == 5
    assert both[0]["rendered"].startswith('<|tools|>\n[{"name": "shell"}]<|end|>\n<|system|>\nRules.') and '"cmd' in both[0]["rendered"]


def test_near_classes_of_several_rows(spark):
    # Rows that share a class, repeat it exactly, or fit only once another bucket is full; chains and blocks of near classes.
    rng = random.Random(11)
    rows, near = [], {(c, c + 1) for c in range(0, 60, 2)} | {(a, b) for a in range(60, 80) for b in range(a + 1, 80)}
    for k in range(600):
        c = rng.randrange(90)
        rows.append((f"s{k % 3}", k // 3, k, f"t{c}-{rng.randrange(3)}", rng.choice([None, 5, 6]), rng.choice([None, 20]), c))
    df = spark.createDataFrame(rows, "source string, place long, row_id long, identity string, short_tokens int, long_tokens int, class_id long")
    budgets = [("s0", 60, 150), ("s1", 40, 200), ("s2", 500, 900)]
    got = selection.select_corpus(df, spark.createDataFrame(sorted(near), "left_id long, right_id long"), [selection.Budget(*b) for b in budgets])
    tasks, classes, want = set(), set(), []
    for source, *sizes in budgets:
        target, spent = dict(zip(("short", "long"), sizes, strict=True)), {"short": 0, "long": 0}
        for s, _, i, identity, a, b, c in rows:
            if s != source or identity in tasks or c in classes or any((min(c, d), max(c, d)) in near for d in classes):
                continue
            fits = {k: n for k, n in (("short", a), ("long", b)) if n is not None and spent[k] < target[k]}
            if fits:
                best = max(fits, key=lambda k: (target[k] - spent[k]) / target[k])
                spent[best] += fits[best]
                tasks.add(identity)
                classes.add(c)
                want.append((i, best, fits[best]))
    assert sorted(tuple(r) for r in got.select("row_id", "bucket", "tokens").collect()) == sorted(want) and len(want) > 20
