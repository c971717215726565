"""Held-out decontamination: exact and shingle overlap, identifier search, exclusion and clearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.minimizers import minimized
from quern.functions.shared import cut
from quern.functions.text import fold_ids, shingled


def grams(rows: DataFrame, id: str, text: str, size: int = 5) -> DataFrame:
    """(id, gram): the distinct shingles of each row, hashed."""
    return shingled(rows, id, text, size).select(id, F.explode("grams").alias("gram"))


def containment(corpus: DataFrame, cases: DataFrame, id: str = "doc_id", text: str = "text", case_id: str = "item_id", case_text: str = "text", least_common: int = 8, least_share: float = 0.5) -> DataFrame:
    """(id, case_id, common, heldout_grams, containment) of pairs that share enough of the case's shingles.

    The cases' shingles are an inverted index; corpus shingles meet it in an equi-join and are counted for each
    pair. Sizes decide whether Spark broadcasts the index.
    """
    held = grams(cases.select(F.col(case_id).alias("case__"), F.col(case_text).alias("text__")), "case__", "text__")
    sizes = held.groupBy("case__").agg(F.count("*").alias("heldout_grams"))
    own = grams(corpus.select(F.col(id).alias("row__"), F.col(text).alias("text__")), "row__", "text__")
    common = own.join(held, "gram").groupBy("row__", "case__").agg(F.count("*").alias("common")).where(F.col("common") >= least_common)
    found = common.join(sizes, "case__").withColumn("containment", F.col("common") / F.col("heldout_grams")).where(F.col("containment") >= least_share)
    return found.select(F.col("row__").alias(id), F.col("case__").alias(case_id), "common", "heldout_grams", "containment")


def exact_containment(corpus: DataFrame, cases: DataFrame, id: str = "doc_id", text: str = "text", case_id: str = "item_id", case_text: str = "text", least_chars: int = 40) -> DataFrame:
    """(id, case_id) where the case's stripped text of 40 characters or more stands in the row's, case ignored.

    A row that holds the text has all of its minimizers, so rows and cases meet on one of them, the one that fewest rows have,
    and the texts are compared after. Rows' minimizers that no case has go first. Null texts match nothing.
    """
    rows = corpus.select(F.col(id).alias("row__"), F.lower(F.col(text)).alias("text__"))
    held = cases.select(F.col(case_id).alias("case__"), F.lower(F.trim(F.col(case_text))).alias("needle")).where(F.length("needle") >= least_chars)
    marks = cut(minimized(held.withColumn("both__", F.struct("case__", F.xxhash64("needle").alias("body"))), "both__", "needle", least_chars), "marks")
    own = cut(minimized(rows, "row__", "text__", least_chars).join(marks.select("key").distinct(), "key", "left_semi"), "rows-of-marks")
    often = own.groupBy("key").agg(F.count("*").alias("n"))
    # A case that has a minimizer which no row has stands in none.
    rarest = marks.join(often, "key", "left").groupBy("both__").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best")).where("best.n > 0")
    met = own.join(rarest.select("both__", F.col("best.key").alias("key")), "key").select("row__", "both__")
    found = rows.join(met, "row__").join(held.select(F.struct("case__", F.xxhash64("needle").alias("body")).alias("both__"), "needle"), "both__").where(F.contains("text__", F.col("needle")))
    return found.select(F.col("row__").alias(id), F.col("both__.case__").alias(case_id)).distinct()


def overlap_matches(corpus: DataFrame, cases: DataFrame, id: str = "doc_id", text: str = "text", case_id: str = "item_id", case_text: str = "text") -> DataFrame:
    """Pairs by either rule: (id, case_id, exact_text, containment); containment is null for exact pairs under it."""
    exact = exact_containment(corpus, cases, id, text, case_id, case_text).withColumn("exact_text", F.lit(True))
    lexical = containment(corpus, cases, id, text, case_id, case_text).select(id, case_id, "containment")
    return exact.join(lexical, [id, case_id], "full").withColumn("exact_text", F.coalesce("exact_text", F.lit(False)))


#: By the least length of a needle: the length of its grams and their distance in rows. A row's grams from every
#: `step`-th character on and any `step` neighbouring grams of a needle share one where the needle stands in the row.
_GRAMS = ((16, 8, 8), (8, 4, 4), (4, 3, 2), (3, 3, 1), (2, 2, 1), (1, 1, 1))


def needle_matches(rows: DataFrame, needles: DataFrame, id: str, text: str, needle: str = "needle") -> DataFrame:
    """(id, needle): folded identifiers found anywhere in the folded text; one that folds to nothing matches nothing.

    `needles` is a table of any size. An inverted index holds, of each needle, the run of neighbouring grams that is
    rarest among the rows' grams; what meets in it is compared. Lengths are taken in classes, each with its own grams.
    """
    wanted = needles.select(fold_ids(F.col(needle)).alias("needle")).where("needle <> ''").distinct()
    wanted = cut(wanted.withColumn("class", F.coalesce(*[F.when(F.length("needle") >= low, low) for low, _, _ in _GRAMS])), "needles")
    source = rows.select(F.col(id).alias("id__"), fold_ids(F.col(text)).alias("text__"))
    used, met = {r["class"] for r in wanted.select("class").distinct().collect()}, None
    for low, size, step in _GRAMS:
        if low not in used:
            continue
        own = wanted.where(F.col("class") == low).select("needle", F.posexplode(F.expr(f"transform(sequence(1, length(needle) - {size - 1}), i -> xxhash64(substring(needle, i, {size})))")).alias("place", "key"))
        grams = F.explode(F.regexp_extract_all("text__", F.lit(f"(?s)(?=(.{{{size}}})).{{{step}}}"), F.lit(1)))
        held = source.select("id__", grams.alias("gram")).select("id__", F.xxhash64("gram").alias("key")).join(own.select("key").distinct(), "key", "left_semi").distinct()
        held = cut(held, "grams-met")
        often = held.groupBy("key").agg(F.count("*").alias("n"))
        run = Window.partitionBy("needle").orderBy("place").rowsBetween(0, step - 1)  # a needle's own grams
        runs = own.join(often, "key", "left").select("needle", "place", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("n"), F.count("*").over(run).alias("wide"), F.collect_list("key").over(run).alias("keys"))
        best = runs.where(F.col("wide") == step).groupBy("needle").agg(F.min(F.struct("n", "place", "keys")).alias("best")).where("best.n > 0")
        found = held.join(best.select("needle", F.explode("best.keys").alias("key")).distinct(), "key").select("id__", "needle")
        met = found if met is None else met.unionByName(found)
    if met is None:
        return source.where("false").select(F.col("id__").alias(id), F.lit("").alias("needle"))
    return source.join(met.distinct(), "id__").where(F.contains("text__", F.col("needle"))).select(F.col("id__").alias(id), "needle").distinct()


def exclusions(*reports: DataFrame) -> DataFrame:
    """The distinct ids of several reports, each with one column."""
    out = reports[0].toDF("excluded")
    for report in reports[1:]:
        out = out.union(report.toDF("excluded"))
    return out.distinct()


def exclude(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no report; a null key is never excluded."""
    return rows.join(excluded.select(F.col("excluded").alias(key)).dropna(), key, "left_anti")


def screen_status(matches: DataFrame, found: str, clear: str) -> DataFrame:
    """One row: status, unresolved_overlaps."""
    return matches.agg(F.count("*").alias("unresolved_overlaps")).select(F.when(F.col("unresolved_overlaps") > 0, found).otherwise(clear).alias("status"), "unresolved_overlaps")


def corpus_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: an order-free identity of a corpus, the sum of row hashes with their count."""
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("corpus_digest"))


def clearance(corpus: DataFrame, reports: DataFrame, expected_cases: DataFrame) -> DataFrame:
    """Violations of an overlap clearance; empty means cleared.

    `corpus`: one row with corpus_digest. `reports`: name, corpus_digest, status, expected_status, unresolved_overlaps.
    `expected_cases`: suite, expected, observed.
    """
    bound = reports.crossJoin(F.broadcast(corpus.select(F.col("corpus_digest").alias("own"))))  # one row by construction
    digest = bound.where(~F.col("own").eqNullSafe(F.col("corpus_digest"))).select(F.lit("corpus_digest").alias("rule"), F.col("name").alias("key"), F.col("own").alias("expected"), F.col("corpus_digest").alias("observed"))
    status = reports.where(~F.col("status").eqNullSafe(F.col("expected_status"))).select(F.lit("status"), "name", "expected_status", "status")
    open_ = reports.where("unresolved_overlaps is null or unresolved_overlaps > 0").select(F.lit("unresolved_overlaps"), "name", F.lit("0"), F.col("unresolved_overlaps").cast("string"))
    cases = expected_cases.where(~F.col("expected").eqNullSafe(F.col("observed"))).select(F.lit("suite_cases"), "suite", F.col("expected").cast("string"), F.col("observed").cast("string"))
    return digest.union(status).union(open_).union(cases)


def screened_fields(cases: DataFrame, id: str = "id", fields: tuple[str, ...] = ("prompt", "code")) -> DataFrame:
    """(id, field, text): one row for each field of a case that isn't empty."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return cases.select(id, each.alias("x")).where("x.text is not null and x.text <> ''").select(id, "x.field", "x.text")


def screen_fields(corpus: DataFrame, cases: DataFrame, id: str = "doc_id", text: str = "text", case_id: str = "id", fields: tuple[str, ...] = ("prompt", "code"), exact: bool = True) -> DataFrame:
    """(id, case_id, field, exact_text, containment): the overlap report of each field of the cases."""
    held = screened_fields(cases, case_id, fields).withColumn("both", F.struct(case_id, "field"))
    if exact:
        found = overlap_matches(corpus, held, id, text, "both", "text")
    else:
        found = containment(corpus, held, id, text, "both", "text").select(id, "both", F.lit(False).alias("exact_text"), "containment")
    return found.select(id, F.col(f"both.{case_id}").alias(case_id), F.col("both.field").alias("field"), "exact_text", "containment")


def origin_rows(selected: DataFrame, upstream: DataFrame) -> DataFrame:
    """Selected rows with their upstream rows, by source and position."""
    return selected.join(upstream, ["source", "source_index"])


def origin_metadata(metadata, keys: tuple[str, ...] = ("trajectory_id", "image", "crate_name", "task", "episode", "trial_name", "uuid")):
    """The identifying entries of a row's metadata map."""
    return F.map_filter(metadata, lambda k, _: k.isin(*keys))
