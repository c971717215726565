"""Words, shingles, canonical forms and digests as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.batches import pieces
from quern.functions.textvec import shingle_sets

#: A word is a run of letters, digits and underscores in any script; Spark's and DuckDB's \w are ASCII.
WORD = r"[\p{L}\p{N}_]+"
#: A default token: a word or a single other visible character.
TOKEN = WORD + r"|[^\s\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once: an expression that a lambda repeats would be computed each time."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The lower-case words of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def regex_tokens(text: Column) -> Column:
    """Default tokens: words and single other visible characters, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def shingle_set(text: Column, size: int = 5) -> Column:
    """Distinct runs of `size` words, each joined by spaces; null text and fewer words give an empty array."""
    whole = let(words(F.coalesce(text, F.lit(""))), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(whole)


def shingled(rows: DataFrame, id: str, text: str, size: int = 5) -> DataFrame:
    """(id, grams): the sorted distinct shingles of each text as 64-bit hashes, empty for fewer words.

    Sets are compared by these, exact but for collisions: two different shingles collide with a probability
    of 2^-64. Spark splits the words, numpy hashes them batch by batch; higher-order functions over
    word arrays took ten times as long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size, short=False)
                cuts = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(cuts, flat)], names=["id", "grams"])

    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), bare.alias("text")).mapInArrow(run, f"id {kind}, grams array<bigint>").withColumnRenamed("id", id)


def fold_ids(text: Column) -> Column:
    """Lower case without anything but a-z and 0-9: the form in which identifiers are searched."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def missing_if_falsy(value: Column) -> Column:
    """Null for an empty string: the sources treat '' as missing."""
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[missing_if_falsy(v.cast("string")) for v in values])


def bytes_label(value: Column) -> Column:
    """1536 as `1.50 KiB`; units of 1024 up to TiB, exact halves to the even digit."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    label = F.format_string("%.2f TiB", F.bround(value / float(1024**4), 2))
    for power in reversed(range(4)):
        label = F.when(value < 1024 ** (power + 1), F.format_string(f"%.2f {units[power]}", F.bround(value / float(1024**power), 2))).otherwise(label)
    return label


def token_ids_digest(ids: Column) -> Column:
    """SHA-256 over the ids as big-endian 32-bit numbers."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 8, "0")), "")), 256)


def canonical_json(value, compact: bool = False) -> str:
    """Sorted keys; with `compact`, separators without spaces. NaN is refused."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":") if compact else None)


@F.pandas_udf(StringType())
def canonical(documents: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null stays null."""
    return documents.map(lambda x: None if x is None else canonical_json(json.loads(x)))


def json_digest(document: Column) -> Column:
    """SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical(document), 256)


def shuffled_key(id: Column, seed: int = 42) -> Column:
    """A key whose order is a fixed permutation, the same in every engine and for any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id.cast("string")))
