"""Vectors as packed bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.textvec import text_bytes


def whole(vector: Column) -> Column:
    """The vector isn't null and holds no null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double"))), F.lit(False))


def matrix(column, kind) -> np.ndarray:
    """(rows, components) of a column of packed vectors that all have one length."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    return data.view(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, initial=0)
    x = x / np.where(top > 0, top, 1)[:, None]
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]
