"""Token counts and ids by a vocabulary file of a public tokenizer, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of a `tokenizer.json`, once for each worker; a worker uses one thread, as Spark spreads the work."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def token_counts(texts: Column, path: str) -> Column:
    """The number of tokens of each text of an array of texts, no special tokens added; null texts count as empty ones.

    `path` names the vocabulary on every machine. A null array stays null.
    """

    @F.pandas_udf("array<int>")
    def count(column: pd.Series) -> pd.Series:
        known = tokenizer(path)
        sizes = [0 if x is None else len(x) for x in column]
        flat = ["" if t is None else t for x in column if x is not None for t in x]
        found = []
        for at in range(0, len(flat), 256):  # encodings are large
            found += [len(e.ids) for e in known.encode_batch(flat[at : at + 256], add_special_tokens=False)]
        cuts = np.r_[0, np.cumsum(sizes)]
        return pd.Series([None if x is None else found[a:b] for x, a, b in zip(column, cuts[:-1], cuts[1:], strict=True)])

    return count(texts)
