"""Python data sources for formats that Spark doesn't read: tensor file headers and Arrow shards."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_LIMIT = 100_000_000


def read_header(path: str | Path) -> tuple[dict, int]:
    """(header, its length) of a tensor file: eight little-endian bytes of length, then JSON. The payload isn't read."""
    with open(path, "rb") as file:
        lead = file.read(8)
        if len(lead) != 8:
            raise ValueError(f"{Path(path).name}: no header length")
        length = struct.unpack("<Q", lead)[0]
        if not 0 < length <= HEADER_LIMIT:
            raise ValueError(f"{Path(path).name}: implausible header length {length}")
        header = file.read(length)
        if len(header) != length:
            raise ValueError(f"{Path(path).name}: truncated header")
    return json.loads(header), length


class _Shard(InputPartition):
    def __init__(self, path: str, first: int = 0) -> None:
        super().__init__(path)
        self.path, self.first = path, first


class _TensorReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[_Shard]:
        return [_Shard(str(p)) for p in sorted(Path(self.folder).glob("*.safetensors"))]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if not isinstance(partition, _Shard):
            return
        header, length = read_header(partition.path)
        path = Path(partition.path)
        for name, meta in header.items():
            if name != "__metadata__":
                start, end = meta["data_offsets"]
                yield name, path.name, meta["dtype"], list(meta["shape"]), start, end, 8 + length, path.stat().st_size, length


class TensorHeaders(DataSource):
    """`spark.read.format("tensorheaders").load(folder)`: one row for each tensor, a partition for each shard."""

    @classmethod
    def name(cls) -> str:
        return "tensorheaders"

    def schema(self) -> str:
        return "name string, shard string, dtype string, shape array<bigint>, start bigint, end bigint, base bigint, size_bytes bigint, header_bytes bigint"

    def reader(self, schema) -> _TensorReader:
        return _TensorReader(self.options["path"])


class _ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Shard]:
        out, first = [], 0
        for path in self.paths:
            out.append(_Shard(path, first))
            first += sum(len(b) for b in _batches(path))
        return out

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        at = partition.first
        for batch in _batches(partition.path):
            place = pa.array(range(at, at + len(batch)), pa.int64())
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "source_index"])


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    with pa.memory_map(path) as source:
        try:
            reader = pa.ipc.open_file(source)
            yield from (reader.get_batch(k) for k in range(reader.num_record_batches))
        except pa.ArrowInvalid:
            source.seek(0)
            yield from pa.ipc.open_stream(source)


class ArrowShards(DataSource):
    """`spark.read.format("arrowshards").option("pattern", "*-train*.arrow").load(folder)`.

    Shards in order of their names, a partition each, with the row's place across all as source_index.
    """

    @classmethod
    def name(cls) -> str:
        return "arrowshards"

    def _paths(self) -> list[str]:
        path = Path(self.options["path"])
        found = [str(path)] if path.is_file() else [str(p) for p in sorted(path.glob(self.options.get("pattern", "*.arrow")))]
        if not found:
            raise FileNotFoundError(f"no Arrow shards in {path}")
        return found

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        from pyspark.sql.types import LongType

        path = self._paths()[0]
        with pa.memory_map(path) as source:
            try:
                schema = pa.ipc.open_file(source).schema
            except pa.ArrowInvalid:
                source.seek(0)
                schema = pa.ipc.open_stream(source).schema
        return from_arrow_schema(schema).add("source_index", LongType())

    def reader(self, schema) -> _ArrowReader:
        return _ArrowReader(self._paths())


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(TensorHeaders)
    spark.dataSource.register(ArrowShards)


def tensor_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """All tensors of a folder's shards; a name that occurs twice is an error."""
    register(spark)
    rows = spark.read.format("tensorheaders").load(folder)
    twice = rows.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate tensor {twice[0]['name']}")
    return rows


def tensor_hashes(tensors: DataFrame, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """(name, sha256) of the tensors' bytes, read in bounded pieces at their place in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, shard, base, start, end in zip(*(batch.column(k).to_pylist() for k in ("name", "shard", "base", "start", "end")), strict=True):
                digest, left = hashlib.sha256(), end - start
                with open(Path(folder) / shard, "rb") as file:
                    file.seek(base + start)
                    while left:
                        piece = file.read(min(chunk, left))
                        if not piece:
                            raise ValueError(f"truncated tensor {name}")
                        digest.update(piece)
                        left -= len(piece)
                out.append((name, digest.hexdigest()))
            yield pa.RecordBatch.from_pydict({"name": pa.array([x for x, _ in out], pa.string()), "sha256": pa.array([x for _, x in out], pa.string())})

    return tensors.select("name", "shard", "base", "start", "end").mapInArrow(run, "name string, sha256 string")


def bad_scales(values: bytes) -> bool:
    """Whether 16-bit brain floats hold one that isn't positive and finite."""
    import numpy as np

    x = np.frombuffer(values, "<u2")
    return bool(((x == 0) | (x >= 0x7F80)).any())


def offset_round_trip(values: bytes) -> bytes:
    """16-bit brain floats after one is added and taken away again, rounded to the nearest (halves to even) each time."""
    import numpy as np

    def rounded(x: np.ndarray) -> np.ndarray:
        bits = x.view("<u4").astype(np.uint64)
        return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")

    def wide(x: np.ndarray) -> np.ndarray:
        return (x.astype("<u4") << 16).view("<f4")

    moved = rounded(wide(np.frombuffer(values, "<u2")) + np.float32(1))
    return rounded(wide(moved) - np.float32(1)).tobytes()


def offset_round_trip_holds(source: bytes, output: bytes) -> bool:
    """Whether `output` is the source's round trip and both are finite."""
    import numpy as np

    finite = lambda x: bool(((np.frombuffer(x, "<u2") & 0x7F80) != 0x7F80).all())
    return finite(source) and finite(output) and offset_round_trip(source) == output


def shard_facts(tensors: DataFrame) -> DataFrame:
    """(shard, size_bytes, header_bytes) of the shards that have tensors."""
    return tensors.groupBy("shard").agg(F.max("size_bytes").alias("size_bytes"), F.max("header_bytes").alias("header_bytes"))
