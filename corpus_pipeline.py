"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what the next one reads.

All stages take `docs` as any table with doc_id and text. Its other columns may bear any name, those of the operators'
results too: they travel as one struct and come back under their names. A null text counts as an empty one, rows that
repeat are rows of their own where a stage doesn't say otherwise, texts are read whole however long, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.shared import cut_to, drop_path, new_path, work_tables
from quern.llm.mixing import mix_sources
from quern.llm.ngram_join import one_of_each
from quern.llm.ordinal import fit_ordinal, grades_of, score_ordinal
from quern.llm.packing import pack_documents
from quern.llm.queries import bound_batches, vocabulary
from quern.llm.suffix_dedup import remove_repeats

#: The struct of the columns beside doc_id and text; no operator has a result of that name.
REST = "columns_beside_id_and_text"


def _slim(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, text and one struct of the other columns, and the name of that struct if there are any."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return docs.select("doc_id", "text"), ()
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias(REST)), (REST,)


def _as_before(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, in their order and types."""
    source = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(f"{REST}.`{c}`")
    return found.select(*(source(f.name).cast(f.dataType).alias(f.name) for f in docs.schema))


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches one half stay.

    Without any rating every grade is as likely, and none stays. A null or empty text has the prior's
    grades, so it stays if most ratings are good. Equal texts share their fate.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    slim, rest = _slim(docs)
    model = fit_ordinal(slim, grades_of(labels), grades=3)
    return _as_before(score_ordinal(slim, model, select=2, carry=rest, with_text=True).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copies link, the one with the least doc_id stays.

    A null doc_id counts as the largest. Texts without words are linked with nothing and stay. Of rows alike in
    doc_id and text one stays.
    """
    bound_batches(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of strings of 200 bytes that also start elsewhere; an n_chars column follows.

    No row goes: a text that is all repeated is empty, and a null one becomes so. A character that loses some of
    its bytes goes.
    """
    bound_batches(spark)
    slim, rest = _slim(docs)
    left = _as_before(remove_repeats(slim, carry=rest), docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it.

    A null source is one of its own. Documents without words come as often as their source's complete epochs.
    """
    whole = "the_whole_row"
    mixed = mix_sources(docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole)), keep=(whole,))
    return mixed.where("copies > 0").select(whole, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(f"{whole}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids. A null or empty text has the end id only."""
    bound_batches(spark)
    return pack_documents(docs, vocabulary())


STAGES = [("quality classifier", select_quality), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("mixing sources", mix), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; between stages rows are written and read again.

    A stage's work tables go when its result is written, and that goes when the next one's is.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with work_tables(spark) as made:
            path = new_path(spark, name.replace(" ", "-"))
            made.remove(path)
            docs = cut_to(stage(spark, docs, sf_dir), path)
        if last:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
