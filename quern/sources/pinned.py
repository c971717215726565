"""A catalogue of sources with pinned revisions; anything that isn't pinned is refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.corpus import PREFERRED_SPLITS


@dataclass(frozen=True)
class Source:
    """Local tables of one dataset at one revision: variant -> split -> path."""

    name: str
    revision: str
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


class Catalog:
    """Loads splits of approved sources only, at their pinned revision only."""

    def __init__(self, spark: SparkSession, sources: list[Source]) -> None:
        self.spark, self.sources = spark, {s.name: s for s in sources}

    def load(self, name: str, revision: str | None = None, variant: str = "__default__", split: str | None = None) -> DataFrame:
        """A split's rows with dataset, revision and split attached; without a split, the preferred one."""
        if name not in self.sources:
            raise LookupError(f"unapproved dataset requested: {name!r}")
        source = self.sources[name]
        if revision not in (None, source.revision):
            raise LookupError(f"dataset revision mismatch for {name}: expected {source.revision}, got {revision}")
        splits = source.tables[variant]
        split = split or next((s for s in PREFERRED_SPLITS if s in splits), next(iter(splits)))
        rows = self.spark.read.parquet(splits[split])
        return rows.select("*", F.lit(name).alias("dataset"), F.lit(source.revision).alias("revision"), F.lit(split).alias("split"))

    def split_counts(self) -> DataFrame:
        """(dataset, variant, split, n_rows, fingerprint) of every table of the catalogue."""
        out = self.spark.createDataFrame([], "dataset string, variant string, split string, n_rows long, fingerprint string")
        for s in self.sources.values():
            for variant, splits in s.tables.items():
                for split, path in splits.items():
                    rows = self.spark.read.parquet(path)
                    counted = rows.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
                    out = out.unionByName(counted.select(F.lit(s.name).alias("dataset"), F.lit(variant).alias("variant"), F.lit(split).alias("split"), "n_rows", "fingerprint"))
        return out
