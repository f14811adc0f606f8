"""Tables written between steps, in the folder that all executors share, and rows handed to Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Rows that become Python objects at once, and bytes of a batch on its way to a Python worker.
ROWS, BATCH_BYTES = 1000, 4 << 20
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, as in tests, a local master gets a temporary folder; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="framesift-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a new Parquet table, so that a lost executor repeats no earlier step."""
    spark = df.sparkSession
    path = f"{folder(spark)}/framesift/{name}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables saved inside go at the end, but for those saved by what this gives: what is written by then needs the others no more.

    Only for callers that write what they keep inside; a DataFrame that still reads a deleted table would fail."""
    mine: list[str] = []
    _open.append(mine)
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        before = len(mine)
        out = saved(df, name)
        kept.extend(mine[before:])
        return out

    try:
        yield keep
    finally:
        _open.pop()  # the innermost one
    _delete(spark, [p for p in mine if p not in kept])


def _arrow(kind) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return _ARROW[kind.simpleString()]


def by_bytes(rows: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends batches of BATCH_BYTES at most (or less, if so set) to Python workers.

    Spark's own bound is 10,000 rows or 64 MB, which JVM and worker of each core hold outside the heap at the same time."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(name).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows


def map_frames(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but doc_id stays a 64-bit number beside nulls (a pandas column of floats would change large ids),
    and at most ROWS rows come at once."""
    kind = pa.schema([(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(schema)])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                place = part.schema.get_field_index("doc_id")
                out = (part.drop_columns(["doc_id"]) if place >= 0 else part).to_pandas()
                if place >= 0:
                    out.insert(place, "doc_id", pd.array(part.column(place), dtype=pd.ArrowDtype(pa.int64())))
                yield out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            arrays = [pa.array(out[f.name].array if f.name == "doc_id" else out[f.name].tolist() if pa.types.is_nested(f.type) else out[f.name], f.type, from_pandas=True) for f in kind]
            yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=kind)

    return by_bytes(rows).mapInArrow(work, schema)


def filter_rows(rows: DataFrame, keep: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The rows, all columns as they are, for which `keep` gives true for its batch; they stay where they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return by_bytes(rows).mapInArrow(work, rows.schema)


def packed(documents: DataFrame) -> DataFrame:
    """doc_id, packed: the text's bytes, compressed for the shuffles; a null text is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "packed": [c.compress((t or "").encode("utf-8", "replace")) for t in frame["text"]]})

    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, packed binary")


def packed_by_text(documents: DataFrame) -> DataFrame:
    """doc_id, k (a hash of the text, the same as xxhash64), packed: for tables in which an id may stand beside several texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "k": frame["k"], "packed": [c.compress((t or "").encode("utf-8", "replace")) for t in frame["text"]]})

    return map_frames(documents.select("doc_id", F.xxhash64("text").alias("k"), "text"), run, "doc_id long, k long, packed binary")


def unpacked(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)
