"""Tables from files: Parquet, JSON lines with their place, series, logs, samples, streamed chunks, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.telemetry import TELEMETRY

HASH_LIMIT = 16 << 20


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema, one that refuses files of another."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema: blank lines are skipped, malformed ones are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset_key, document): heterogeneous JSON lines as variants, without inferring a schema; blank ones are null.

    offset_key orders the lines of a file; `source_index` of `with_source_index` counts them across files.
    """
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("offset_key"), F.when(F.trim("value") != "", F.parse_json("value")).alias("document"))


def with_source_index(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds source_index: the row's place in order, counted from 0.

    Rows are ranged by the order's leading column, places are counted within ranges and ranges are added up, so that
    no single task sorts the table.
    """
    lead = order[0]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    edges = rows.select(F.col(lead).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.001) if dict(rows.dtypes)[lead] in ("bigint", "int", "double") else []
    bucket = F.lit(0)
    for edge in sorted(set(edges)):
        bucket = bucket + (F.col(lead) > edge).cast("int")
    from pyspark.sql import Window

    cut = rows.withColumn("range__", bucket)
    sizes = cut.groupBy("range__").agg(F.count("*").alias("n__"))
    sizes = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range__").orderBy(*order)) - 1
    return cut.join(sizes, "range__").withColumn("source_index", (F.col("before__") + own).cast("long")).drop("range__", "n__", "before__")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one row each."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): instruction and log files whole, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated series with its place; a row that doesn't fit the twelve columns is an error."""
    return spark.read.schema(TELEMETRY).option("sep", "\t").option("mode", "FAILFAST").csv(path).withColumn("seq", F.monotonically_increasing_id())


def read_samples(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(task, doc_id, doc_hash, value) of all samples files below a folder.

    The task is the file's name up to its time stamp. Only rows whose filter is `none` count, a missing one doesn't;
    a metric that is a list counts by its first value.
    """
    schema = f"doc_id long, doc_hash string, filter string, `{metric}` string"
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "samples_*.jsonl").option("mode", "FAILFAST").json(path)
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^samples_(.+?)_\d{4}-\d{2}-\d{2}T[^/]*\.jsonl$", 1)
    value = F.regexp_replace(F.col(f"`{metric}`"), r"^\[\s*([^,\]]+).*$", "$1")
    value = F.when(F.lower(value) == "true", "1").when(F.lower(value) == "false", "0").otherwise(value)
    return raw.where("filter = 'none'").select(task.alias("task"), "doc_id", "doc_hash", value.cast("double").alias("value"))


def find_one(folder: str, pattern: str) -> Path:
    """The one file below a folder that fits; an error unless there is exactly one."""
    found = sorted(Path(folder).rglob(pattern))
    if len(found) != 1:
        raise ValueError(f"expected one {pattern} below {folder}, found {len(found)}")
    return found[0]


def read_chunks(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Streamed responses from (request_id, started, ts, line): text and usage of each `data: ` line but the last mark."""
    schema = "choices array<struct<text:string>>, usage struct<prompt_tokens:long,completion_tokens:long>"
    data = lines.withColumn("line", F.trim("line")).where("startswith(line, 'data: ') and line <> 'data: [DONE]'")
    parsed = data.withColumn("c", F.from_json(F.expr("substring(line, 7)"), schema, {"mode": "FAILFAST"}))
    return parsed.select("request_id", "started", "ts", F.try_element_at("c.choices", F.lit(1))["text"].alias("text"), F.col("c.usage.prompt_tokens").alias("prompt_tokens"), F.col("c.usage.completion_tokens").alias("completion_tokens"))


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, mtime, sha256) of all files below a folder; sha256 up to 16 MiB, null beyond.

    Sizes come from the listing, and only small files are opened.
    """
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = reader().load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    small = reader().load(folder).where(F.col("length") <= HASH_LIMIT).select("path", F.sha2("content", 256).alias("sha256"))
    root = F.lit(f"{Path(folder).resolve()}/")
    return listed.join(small, "path", "left").withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), F.concat(F.lit("^"), root), "")).select("path", "size_bytes", "mtime", "sha256")


def read_yaml(path: str) -> dict:
    """A YAML mapping; anything else is an error."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} is not a mapping")
    return value


def read_optional_json(path: str):
    """A JSON document, or None where there is no file."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else None


def discover_profiles(folder: str) -> list[dict]:
    """The YAML documents of a folder by name; a document's id is its file's name."""
    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        profile = read_yaml(str(path))
        if profile.get("id") != path.stem:
            raise ValueError(f"{path.name} declares the id {profile.get('id')!r}")
        out.append(profile)
    if not out:
        raise ValueError(f"no profiles in {folder}")
    return out


def capped_copy(source: str, target: str, most_bytes: int = 64 << 20) -> bytes:
    """Fetch a local file once: an existing copy is kept as it is, a larger file than the cap is an error."""
    path = Path(target)
    if not path.exists():
        with open(source, "rb") as file:
            data = file.read(most_bytes + 1)
        if len(data) > most_bytes:
            raise ValueError(f"{source} is over {most_bytes} bytes")
        with path.open("xb") as file:
            file.write(data)
    return path.read_bytes()


def identity_row(spark: SparkSession, packages: list[str], revision: str | None = None) -> DataFrame:
    """One row: the revision and the versions of packages, null where one isn't installed."""
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return spark.createDataFrame([(revision, {p: version(p) for p in packages})], "revision string, packages map<string,string>")
