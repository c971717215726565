"""Conversation structure repair: the cheapest edits that make roles `(s?(ua)+)?`, by a rank-compressed dynamic program.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate turns must go) and Insert of an empty
user or assistant turn (2); a truncated turn that stays adds 1. Of the cheapest edits those with the least audit string,
the edits' initials in order, are taken. A turn's step is a macro edit: a run of at most two inserts and then the turn's own
edit. Its codes, D, ID, IID, IIK, IIR, IK, IR, K and R, are prefix-free, so that strings of as many codes are in
the order of their first different code. A layer therefore holds, for each of four states (nothing yet, after the system
turn, after a user turn, after an assistant turn), a cost and the rank of its string among the four; a tie goes to the
least (rank of the parent, code), and strings are written from parent pointers afterwards.

Turns are ordered by range over all machines, so a conversation of any size is dealt to many tasks. One that lies
inside a task and in one chunk is solved there. All others go through chunks of at most `ROWS` turns or about `BYTES`:
a chunk's program runs from each of the four states, and the 4 x 4 costs and ranks of chunks are folded
in order, by the same rule; then each chunk writes its part. Duplicates across chunks meet by digest, one row a chunk.
A conversation's audit and SHA-256 are single values, so its parts stream through one task at the end.

Nulls and oddities: a null role or text is one space. Turns go by number, nulls first; of equal numbers by role
and a digest, so equal turns are neighbours. A null conversation id is a conversation of its own. A role counts by its first
character; an empty role can't be kept. Duplicates are told by 128-bit digests of role and text. A conversation all of whose
rows are marked as lost has zeros, an empty audit and the empty string's hash; an empty table gives an empty result. A
very long text is a chunk of its own. Columns other than the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions.shared import cut

ROWS, BYTES = 4096, 1 << 20
#: Codes of macro edits in their order; a code's number is its place.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: States: nothing yet, system, user, assistant. The role that comes next, and where it leads.
_NEXT = "uuau"
_LEADS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLE = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"


def _insert(state: int) -> int:
    return _LEADS[state, _NEXT[state]]


def _edges(symbol: str) -> list[list[tuple[int, int, int]]]:
    """For each state, the (parent, cost, code) that lead to it over a turn; one for each parent, the cheapest and then least."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    late = int(symbol in "SUAO")
    for start in range(4):
        for run in range(3):
            state = start
            for _ in range(run):
                state = _insert(state)
            ends = {"D": (state, 3)}
            if symbol != "D":
                ends["R"] = (_insert(state), 2 + late)
                if (state, symbol.lower()) in _LEADS:
                    ends["K"] = (_LEADS[state, symbol.lower()], late)
            for edit, (end, cost) in ends.items():
                offer = (cost + 2 * run, CODES.index("I" * run + edit))
                found[start, end] = min(found.get((start, end), offer), offer)
    return [[(start, *found[start, end]) for start in range(4) if (start, end) in found] for end in range(4)]


#: By a turn's symbol: D must go; s, u, a and o (another role) may stay, in upper case where truncated.
_EDGES = {symbol: _edges(symbol) for symbol in "DsuaoSUAO"}
#: What a conversation adds at its end in each state: cost and inserts.
_ENDS = ((0, ""), (4, "II"), (2, "I"), (0, ""))


def _ranks(keys: list) -> list[int]:
    """Places of the keys that aren't None in their order, equal keys at one place."""
    order = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    return [0 if k is None else order[k] for k in keys]


def forward(symbols: str, start: int) -> tuple[list[int], list[int], bytearray]:
    """Costs and ranks of the four states after all turns, and four bytes a turn: parent * 16 + code."""
    cost, rank, back = [_NEVER] * 4, [0] * 4, bytearray()
    cost[start] = 0
    for symbol in symbols:
        after, keys = [_NEVER] * 4, [None] * 4
        for state, edges in enumerate(_EDGES[symbol]):
            best = None
            for parent, price, code in edges:
                if cost[parent] < _NEVER:
                    offer = (cost[parent] + price, rank[parent], code, parent)
                    if best is None or offer < best:
                        best = offer
            if best is None:
                back.append(255)
            else:
                after[state], keys[state] = best[0], best[1:3]
                back.append(best[3] * 16 + best[2])
        cost, rank = after, _ranks(keys)
    return cost, rank, back


def audit_to(back: bytearray, turns: int, state: int) -> tuple[str, int]:
    """The string of the edits that end in `state`, and the state where they begin."""
    codes = []
    for i in range(turns - 1, -1, -1):
        step = back[4 * i + state]
        codes.append(CODES[step & 15])
        state = step >> 4
    return "".join(reversed(codes)), state


def _end(cost: list[int], rank: list[int]) -> int:
    return min((s for s in range(4) if cost[s] < _NEVER), key=lambda s: (cost[s] + _ENDS[s][0], rank[s]))


@lru_cache(1 << 14)
def solve(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost, rank, back = forward(symbols, 0)
    state = _end(cost, rank)
    return cost[state] + _ENDS[state][0], audit_to(back, len(symbols), state)[0] + _ENDS[state][1]


def apply(audit: str, roles: list[str], texts: list[str], state: int = 0) -> list[tuple[str, str]]:
    """The (role, text) of the turns that the edits leave, from a state on."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
        elif edit == "K":
            out.append((roles[at], texts[at]))
            state = _LEADS[state, roles[at][0]]
            at += 1
        else:
            out.append((_ROLE[_NEXT[state]], texts[at] if edit == "R" else ""))
            state = _insert(state)
            at += edit == "R"
    return out


def _symbol(role: str, text: str, again: bool) -> tuple[str, int]:
    """A turn's symbol and its first fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    bare = text.rstrip(_SPACE)
    if not bare:
        return "D", 1
    if again:
        return "D", 2
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (letter, 0) if bare[-1] in ".!?" else (letter.upper(), 3)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


def _gaps(turns: list[int]) -> int:
    return turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0


def _lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


_TURNS = "array<struct<role: string, text: string>>"
_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "pid int, chunk int, roles array<string>, texts array<string>, numbers array<long>, marks binary, places array<int>, digests array<binary>"
_SOLVED = f"{_FACTS}, turns {_TURNS}, {_CHUNK}"
#: Bytes of text or rows after which results go out.
_OUT_BYTES, _OUT_ROWS = 4 << 20, 2000


def _mapped(rows: DataFrame, step, schema: StructType) -> DataFrame:
    """`step` gets the batches and the schema of its results."""
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: step(batches, arrow), schema)


def _local(with_turns: bool, rows_most: int, bytes_most: int):
    """Solve the conversations that lie inside a sorted partition in one chunk; cut the others to chunks."""

    def run(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        out, weight = [], 0
        held, size, key, conv, chunks, edge = [], 0, None, None, 0, True

        def flush(whole: bool) -> None:
            nonlocal weight, held, size, chunks
            seen, symbols, faults, places = set(), [], [0] * 4, []
            for i, (_, role, text, digest) in enumerate(held):
                symbol, fault = _symbol(role, text, digest in seen)
                if fault != 1 and digest not in seen:
                    seen.add(digest)
                    places.append(i)
                symbols.append(symbol)
                faults[fault] += 1
            roles, texts = [r[1] for r in held], [r[2] for r in held]
            row = dict.fromkeys(arrow.names) | {"k": key, "conv": conv, "pid": pid, "chunk": chunks}
            if whole:
                cost, audit = solve("".join(symbols))
                left = apply(audit, roles, texts)
                row |= {"gaps": _gaps([r[0] for r in held if r[0] is not None]), "blank": faults[1], "duplicate": faults[2], "truncated": faults[3], "illegal": _illegal([r[:1] for r in roles]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(_lines(left)).hexdigest()}
                if with_turns:
                    row["turns"] = [{"role": r, "text": t} for r, t in left]
            else:
                row |= {"roles": roles, "texts": texts, "numbers": [r[0] for r in held], "marks": "".join(symbols).encode(), "places": places, "digests": [held[i][3] for i in places]}
            out.append(row)
            weight += size if with_turns or not whole else 0
            held, size, chunks = [], 0, chunks + 1

        for batch in batches:
            for k, c, lost, number, role, text, digest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        flush(not edge and not chunks)
                        edge = False
                    key, conv, chunks = k, c, 0
                elif held and (len(held) >= rows_most or size + len(text) > bytes_most):
                    flush(False)
                if not lost:
                    held.append((number, role, text, digest))
                    size += len(text)
                if weight > _OUT_BYTES or len(out) >= _OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, weight = [], 0
        if key is not None:
            flush(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


_SUMMARY = "k string, pid int, chunk int, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long"


def _settled(marks: bytes, again: list[int] | None) -> str:
    """A chunk's symbols, once the turns that stand in earlier chunks are known."""
    marks = bytearray(marks)
    for i in again or ():
        marks[i] = ord("D")
    return marks.decode()


def _summaries(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            symbols = _settled(row["marks"], row["again"])
            tables = [forward(symbols, start)[:2] for start in range(4)]
            blank = sum(not t.rstrip(_SPACE) for t in row["texts"])
            initials = [r[:1] for r in row["roles"]]
            numbers = [n for n in row["numbers"] if n is not None]
            out.append({
                "k": row["k"], "pid": row["pid"], "chunk": row["chunk"], "costs": [c for t in tables for c in t[0]], "ranks": [r for t in tables for r in t[1]],
                "blank": blank, "duplicate": symbols.count("D") - blank, "truncated": sum(x in "SUAO" for x in symbols), "illegal": _illegal(initials),
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
                "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "distinct": len(set(numbers)),
            })
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


_FOLDED = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, pid int, chunk int, enter int, leave int, inserts string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """The rows of each key in turn, from batches sorted by it; a key's rows are never held together."""
    rows = (row for batch in batches for row in batch.to_pylist())
    yield from groupby(rows, key=lambda row: row["k"])


def _fold(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation in order: its facts (a row without `pid`) and the states where each chunk begins and ends."""
    blank_row = dict.fromkeys(arrow.names)
    for key, chunks in _streamed(batches):
        cost, rank, parents, where = [0, _NEVER, _NEVER, _NEVER], [0] * 4, bytearray(), []
        facts = {"k": key, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        low = high = last = None
        distinct = 0
        for row in chunks:
            after, keys = [_NEVER] * 4, [None] * 4
            for state in range(4):
                offers = [(cost[s] + row["costs"][4 * s + state], rank[s], row["ranks"][4 * s + state], s) for s in range(4) if cost[s] < _NEVER and row["costs"][4 * s + state] < _NEVER]
                if offers:
                    best = min(offers)
                    after[state], keys[state] = best[0], best[1:3]
                parents.append(best[3] if offers else 255)
            cost, rank = after, _ranks(keys)
            where.append((row["pid"], row["chunk"]))
            for name in ("blank", "duplicate", "truncated", "illegal"):
                facts[name] += row[name]
            if row["first"] is not None:
                facts["illegal"] += last is not None and last + row["first"] not in ("su", "ua", "au")
                last = row["last"]
            if row["low"] is not None:
                distinct += row["distinct"] - (high == row["low"])
                low, high = row["low"] if low is None else low, row["high"]
        state = _end(cost, rank)
        facts |= {"cost": cost[state] + _ENDS[state][0], "gaps": 0 if low is None else high - low + 1 - distinct}
        inserts, out = _ENDS[state][1], [blank_row | facts]
        for i in range(len(where) - 1, -1, -1):
            enter = parents[4 * i + state]
            out.append(blank_row | {"k": key, "pid": where[i][0], "chunk": where[i][1], "enter": enter, "leave": state, "inserts": inserts})
            state, inserts = enter, ""
            if len(out) >= _OUT_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)


_WRITTEN = f"k string, pid int, chunk int, audit string, body binary, turns {_TURNS}"


def _write(with_turns: bool):
    """Each chunk's part of the audit and of the repaired lines."""

    def run(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols = _settled(row["marks"], row["again"])
                audit, _ = audit_to(forward(symbols, row["enter"])[2], len(symbols), row["leave"])
                audit += row["inserts"]
                left = apply(audit, row["roles"], row["texts"], row["enter"])
                yield pa.RecordBatch.from_pylist([{"k": row["k"], "pid": row["pid"], "chunk": row["chunk"], "audit": audit, "body": _lines(left) if left else None, "turns": [{"role": r, "text": t} for r, t in left] if with_turns else None}], schema=arrow)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, parts in _streamed(batches):
        hashed, audit, any_line = hashlib.sha256(), [], False
        for row in parts:
            audit.append(row["audit"])
            if row["body"] is not None:
                hashed.update((b"\n" if any_line else b"") + row["body"])
                any_line = True
        yield pa.RecordBatch.from_pydict({"k": [key], "audit": ["".join(audit)], "repaired_sha256": [hashed.hexdigest()]})


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, lost: str | None) -> DataFrame:
    gone = F.lit(False) if lost is None else F.coalesce(F.col(lost), F.lit(False))
    slim = rows.select(F.coalesce(F.concat(F.lit("0"), F.col(conv).cast("string")), F.lit("1")).alias("k"), F.col(conv).alias("conv"), gone.alias("lost"), F.col(turn).cast("long").alias("number"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    slim = slim.withColumn("text", F.when(F.col("lost"), F.lit("")).otherwise(F.col("text")))
    return slim.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))


def _solve(rows: DataFrame, conv: str, turn: str, role: str, text: str, lost: str | None, with_turns: bool, rows_most: int, bytes_most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local, folded, written): conversations solved in place; facts of the others and their chunks' states; their parts."""
    ready = _prepared(rows, conv, turn, role, text, lost)
    order = ["k", F.col("number").asc_nulls_first(), "role", "digest"]
    ordered = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ready.schema["conv"].dataType
    schema = StructType().add("k", "string").add("conv", kind)
    for field in StructType.fromDDL(_SOLVED):
        schema = schema.add(field)
    local = cut(_mapped(ordered, _local(with_turns, rows_most, bytes_most), schema), "conversations")
    chunks = local.where("cost is null").select("k", "pid", "chunk", "roles", "texts", "numbers", "marks", "places", "digests")
    at = F.struct("pid", "chunk")
    seen = chunks.select("k", at.alias("at"), F.explode(F.arrays_zip("digests", "places")).alias("x")).select("k", "at", "x.digests", "x.places")
    first = seen.groupBy("k", "digests").agg(F.min("at").alias("first"))
    again = seen.join(first, ["k", "digests"]).where("at <> first").groupBy("k", "at").agg(F.collect_list("places").alias("again"))
    chunks = chunks.drop("places", "digests").join(again.select("k", "at.pid", "at.chunk", "again"), ["k", "pid", "chunk"], "left")
    chunks = cut(chunks, "conversation-chunks")
    parts = _mapped(chunks, _summaries, StructType.fromDDL(_SUMMARY)).repartition("k").sortWithinPartitions("k", "pid", "chunk")
    folded = cut(_mapped(parts, _fold, StructType.fromDDL(_FOLDED)), "conversation-states")
    chosen = folded.where("pid is not null").select("k", "pid", "chunk", "enter", "leave", "inserts")
    written = _mapped(chunks.join(chosen, ["k", "pid", "chunk"]), _write(with_turns), StructType.fromDDL(_WRITTEN))
    return local, folded, written


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None, rows_most: int = ROWS, bytes_most: int = BYTES) -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    `lost` names a boolean column: rows where it is true are no turns and only name their conversation.
    """
    local, folded, written = _solve(rows, conv, turn, role, text, lost, False, rows_most, bytes_most)
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    ids = local.where("cost is null").groupBy("k").agg(F.min("conv").alias("conv"))
    ends = written.drop("turns").repartition("k").sortWithinPartitions("k", "pid", "chunk").mapInArrow(_finish, "k string, audit string, repaired_sha256 string")
    split = ids.join(folded.where("pid is null").drop("pid", "chunk", "enter", "leave", "inserts"), "k").join(ends, "k")
    return local.where("cost is not null").select("conv", *facts).unionByName(split.select("conv", *facts)).withColumnRenamed("conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None, rows_most: int = ROWS, bytes_most: int = BYTES) -> DataFrame:
    """The repaired conversations in parts: id, part (a number that orders a conversation's parts), turns (role, text).

    Most conversations have one part; a conversation without turns has one that is empty.
    """
    local, _, written = _solve(rows, conv, turn, role, text, lost, True, rows_most, bytes_most)
    part = (F.col("pid").cast("long") * (1 << 32) + F.col("chunk")).alias("part")
    ids = local.where("cost is null").groupBy("k").agg(F.min("conv").alias("conv"))
    split = written.join(ids, "k").select(F.col("conv").alias(conv), part, "turns")
    return local.where("cost is not null").select(F.col("conv").alias(conv), part, "turns").unionByName(split)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Fixed faults for trials, by CRC-32 of `conv:turn` modulo 20; nulls are one space.

    0 loses the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its
    role user. Adds a boolean column `lost`.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    spoiled = rows.select(F.col(conv), F.col(turn), blank(role).alias(role), blank(text).alias(text), fault.alias("fault"))
    spoiled = spoiled.withColumn(text, F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)))
    spoiled = spoiled.withColumn(role, F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col(role))).withColumn("lost", F.col("fault") == 0)
    return spoiled.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "fault")
