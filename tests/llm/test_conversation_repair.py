"""Conversation repair against exhaustive search and against a program over whole strings."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pandas as pd
import pytest

from quern.llm import conversation_repair as cr
from quern.llm import queries

VALID = re.compile(r"(s?(ua)+)?")
SF = "/root/testdata/sf0.001"


def exhaustive(symbols):
    """Least (cost, audit) over all edits, with up to two inserts in each gap."""
    gaps = [(), *[(x,) for x in "ua"], *itertools.product("ua", repeat=2)]
    best = None
    for edits in itertools.product(*[["D"] if x == "D" else ["D", "K", "Ru", "Ra"] for x in symbols]):
        for runs in itertools.product(gaps, repeat=len(symbols) + 1):
            roles, audit, cost = "", "", 0
            for i, run in enumerate(runs):
                roles, audit, cost = roles + "".join(run), audit + "I" * len(run), cost + 2 * len(run)
                if i < len(symbols):
                    edit, x = edits[i], symbols[i]
                    audit += edit[0]
                    cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (edit[0] != "D" and x in "SUAO")
                    roles += "" if edit == "D" else x.lower() if edit == "K" else edit[1]
            if VALID.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_exhaustive():
    for n in range(4):
        for symbols in itertools.product("DsuaoUA" if n < 3 else "DsuaU", repeat=n):
            if n < 3 or random.Random("".join(symbols)).random() < 0.12:
                assert cr.solve("".join(symbols)) == exhaustive("".join(symbols)), symbols


def by_strings(symbols):
    """The same program with whole strings: (cost, audit) for each role that the last turn left."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def settle(states):
        todo = list(states)
        while todo:
            last = todo.pop()
            cost, audit = states[last]
            for role in follows[last].replace("s", ""):
                offer = cost + 2, audit + "I"
                if offer < states.get(role, (1 << 60, "")):
                    states[role] = offer
                    todo.append(role)
        return states

    states = {"": (0, "")}
    for x in symbols:
        after = {}
        for last, (cost, audit) in settle(states).items():
            offers = [(last, cost + 3, audit + "D")]
            if x != "D":
                late = x in "SUAO"
                offers += [(r, cost + 2 + late, audit + "R") for r in follows[last].replace("s", "")]
                offers += [(x.lower(), cost + late, audit + "K")] if x.lower() in follows[last] else []
            for role, *offer in offers:
                after[role] = min(after.get(role, (1 << 60, "")), tuple(offer))
        states = after
    return min(v for k, v in settle(states).items() if k in ("", "a"))


def plain(rows):
    """Facts of damaged conversations by plain Python: {conv: tuple}."""
    found = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            role = "user" if fault == 4 else role
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            kept += [(turn is not None, turn or 0, role, digest, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        kept.sort()
        turns = [r[1] for r in kept if r[0]]
        seen, symbols, faults = set(), "", [0] * 4
        for _, _, role, _, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            letter = role[0] if role and role[0] in "sua" else "o"
            symbols += "D" if fault in (1, 2) else letter.upper() if fault == 3 else letter
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(kept, kept[1:])]
        cost, audit = by_strings(symbols)
        out, last, at = [], "", 0
        for edit in audit:
            nxt = "a" if last == "u" else "u"
            if edit == "K":
                out.append(kept[at][2] + ":" + kept[at][4])
                last = kept[at][2][0]
            elif edit in "RI":
                out.append({"u": "user:", "a": "assistant:"}[nxt] + (kept[at][4] if edit == "R" else ""))
                last = nxt
            at += edit != "I"
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults[1:], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def many_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "So?  ", "", " \n", None, "A longer text without an end", "Ü. ß", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "sage"]
    rows = []
    for conv in [*range(40), None]:
        turns = [None if rng.random() < 0.05 else t for t in range(rng.choice([0, 1, 2, 5, 9, 14]) + 1)]
        rows += [(conv, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t} {rng.random()}.") for t in turns]
    rows += [(99, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", rng.choice(["Same.", "again", f"{t}!"])) for t in range(700)]  # one large conversation
    rows += [(100, None, "user", "Hot.")] * 50
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_most", [3, 50, 4096])
def test_against_plain(spark, rows_most):
    rows = many_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, k int").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in cr.repair_conversations(cr.damage(df), lost="lost", rows_most=rows_most).collect()}
    assert got == plain(rows)


def test_turns_and_empty(spark):
    rows = many_rows(5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    bodies = {}
    for r in sorted(cr.repaired_turns(cr.damage(df), lost="lost", rows_most=20).collect(), key=lambda r: r["part"]):
        bodies.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["turns"])
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in bodies.items()} == {k: v[-1] for k, v in plain(rows).items()}
    assert cr.repair_conversations(cr.damage(df.limit(0)), lost="lost").count() == 0
    whole = {r["conv_id"]: r["audit"] for r in cr.repair_conversations(spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], df.schema)).collect()}
    assert whole == {1: "KK"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query(spark):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == plain(rows)
