"""Folders of .npy vectors as a Spark data source, `vector_files`.

    vector_files.register(spark)
    spark.read.format("vector_files").load(root).where("category = 'a' and frame < 100")

root/video/*.npy and root/category/video/*.npy; a folder that holds vectors itself is a video. Columns: category (null in the flat
layout), video, frame (trailing number of the file name), nth (row in the file), path, embedding. A file that can't be read, or
holds no vector and no rows of vectors, has a null embedding; with option drop=true it has no row.

Filters on category, video and frame are pushed down: folders and files that they rule out are neither listed nor opened. Option
vectors=false opens no file at all and gives a row each with a null embedding, for queries that need only names. Partitions hold files of
up to `bytes` (64 MB) by their listed sizes, so a video with a third of all files is as many partitions as it needs. Listed are
names and sizes, on the driver, as Spark's own file sources do. Stores: whatever pyarrow.fs opens from a URI.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType

SCHEMA = StructType().add("category", StringType()).add("video", StringType()).add("frame", IntegerType()).add("nth", IntegerType()).add("path", StringType()).add("embedding", ArrayType(FloatType()))
_PUSHED = ("category", "video", "frame")
_ROWS = 1024
#: What a filter says about a value that may be null.
_HOLDS = {
    "EqualTo": lambda x, v: x is not None and x == v, "EqualNullSafe": lambda x, v: x == v, "In": lambda x, v: x is not None and x in v,
    "GreaterThan": lambda x, v: x is not None and x > v, "GreaterThanOrEqual": lambda x, v: x is not None and x >= v,
    "LessThan": lambda x, v: x is not None and x < v, "LessThanOrEqual": lambda x, v: x is not None and x <= v,
    "IsNull": lambda x, v: x is None, "IsNotNull": lambda x, v: x is not None, "StringStartsWith": lambda x, v: x is not None and x.startswith(v),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def vectors_of(content: bytes) -> np.ndarray | None:
    """The rows of a .npy file; one vector is one row. None where there is neither."""
    try:
        x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32))
    except (ValueError, EOFError, OSError):
        return None
    return x if x.ndim == 2 else None


@dataclass
class Files(InputPartition):
    """category, video, frame and path of the files of a task."""

    files: list[tuple[str | None, str, int | None, str]]


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.bytes = int(options.get("bytes", 64 << 20))
        self.vectors = options.get("vectors", "true").lower() == "true"
        self.drop = options.get("drop", "false").lower() == "true"
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", ())
            if kind in _HOLDS and len(column) == 1 and column[0] in _PUSHED:
                self.tests.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def _kept(self, column: str, value: Any) -> bool:
        return all(_HOLDS[kind](value, v) for c, kind, v in self.tests if c == column)

    def _folders(self, store: fs.FileSystem, root: str) -> Iterator[tuple[str | None, str, list[fs.FileInfo]]]:
        listed = lambda p: sorted(store.get_file_info(fs.FileSelector(p)), key=lambda i: i.path)
        for top in listed(root):
            flat, nested = self._kept("video", top.base_name) and self._kept("category", None), self._kept("category", top.base_name)
            if top.type != fs.FileType.Directory or not (flat or nested):
                continue
            inside = listed(top.path)
            own = [i for i in inside if i.type == fs.FileType.File and i.path.endswith(".npy")]
            if own:
                if flat:
                    yield None, top.base_name, own
            elif nested:
                for d in inside:
                    if d.type == fs.FileType.Directory and self._kept("video", d.base_name):
                        yield top.base_name, d.base_name, [i for i in listed(d.path) if i.type == fs.FileType.File and i.path.endswith(".npy")]

    def partitions(self) -> Sequence[InputPartition]:
        store, root = opened(self.root)
        out, held, size = [], [], 0
        for category, video, files in self._folders(store, root):
            for f in files:
                number = re.search(r"(\d+)\.npy$", f.path)
                frame = int(number[1]) if number and int(number[1]) < 1 << 31 else None
                if not self._kept("frame", frame):
                    continue
                if held and size + f.size > self.bytes:
                    out.append(Files(held))
                    held, size = [], 0
                held.append((category, video, frame, f.path))
                size += f.size
        return [*out, Files(held)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.root)
        schema = to_arrow_schema(SCHEMA)
        rows: list[tuple] = []
        for category, video, frame, path in partition.files:
            x = None
            if self.vectors:
                with store.open_input_stream(path) as f:
                    x = vectors_of(f.read())
            if x is not None:
                rows += [(category, video, frame, i, path, v) for i, v in enumerate(x)]
            elif not (self.drop and self.vectors):
                rows.append((category, video, frame, 0, path, None))
            while len(rows) >= _ROWS:
                yield self._batch(rows[:_ROWS], schema)
                rows = rows[_ROWS:]
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorFiles)
