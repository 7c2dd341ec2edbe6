"""Matrices in .npy files as a data source: `spark.read.format("npy")` and `df.write.format("npy")`.

Reading: a path, or a folder of shards. Files are cut in ranges of rows, each of which is a partition that reads its own
bytes. Rows are (row, vector): the row's number along the shards, and its numbers as doubles. Writing: each partition
writes a shard of its own, numbered, of one vector column, and in the commit the shards of tasks that succeeded get
their names and a list of them, so that a task that ran twice leaves one shard. Paths are those that pyarrow's
filesystems know: local ones, file://, hdfs://, s3:// and gs://, and have to be shared by all executors.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a partition reads; rows that are handed on at once.
RANGE, ROWS = 16 << 20, 4096
LIST = "_shards.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


@dataclass
class Shard:
    """A file's rows: where they begin, how many there are and of what."""

    path: str
    offset: int
    rows: int
    columns: int
    kind: str
    by_columns: bool


def header(files: fs.FileSystem, path: str) -> Shard:
    with files.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) not in (1, 2) or kind.hasobject:
            raise ValueError(f"{path} is no matrix of numbers")
        return Shard(path, f.tell(), shape[0], shape[1] if len(shape) == 2 else 1, kind.str, by_columns and len(shape) == 2)


@dataclass
class Rows(InputPartition):
    shard: Shard
    start: int
    end: int
    first: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Rows]:
        files, at = opened(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        paths = [at]
        if info.type == fs.FileType.Directory:
            if files.get_file_info(f"{at}/{LIST}").type == fs.FileType.File:
                with files.open_input_stream(f"{at}/{LIST}") as f:
                    paths = [f"{at}/{name}" for name in json.loads(f.read())]
            else:
                paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy"))
        out, first = [], 0
        for shard in (header(files, p) for p in paths):
            step = max(1, self.range // max(1, shard.columns * np.dtype(shard.kind).itemsize))
            out += [Rows(shard, a, min(a + step, shard.rows), first + a) for a in range(0, shard.rows, step)]
            first += shard.rows
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        files, _ = opened(self.path)
        shard, kind = part.shard, np.dtype(part.shard.kind)
        with files.open_input_file(shard.path) as f:
            for a in range(part.start, part.end, ROWS):
                n = min(ROWS, part.end - a)
                if shard.by_columns:  # a stretch of each column
                    parts = [np.frombuffer(f.read_at(n * kind.itemsize, shard.offset + (c * shard.rows + a) * kind.itemsize), kind) for c in range(shard.columns)]
                    x = np.stack(parts, axis=1) if parts else np.empty((n, 0))
                else:
                    width = shard.columns * kind.itemsize
                    x = np.frombuffer(f.read_at(n * width, shard.offset + a * width), kind).reshape(n, shard.columns)
                flat = pa.array(np.ascontiguousarray(x, np.float64).reshape(-1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shard.columns), flat)
                numbers = pa.array(np.arange(n, dtype=np.int64) + part.first + a - part.start)
                yield pa.RecordBatch.from_arrays([numbers, vectors], names=["row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    place: int
    name: str
    rows: int
    columns: int


class NpyWriter(DataSourceArrowWriter):
    """Shards of partitions, in their order; empty partitions leave none. All vectors have one length."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("dtype", "float32"), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        place, name = context.partitionId(), f"_{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        rows, columns = 0, None
        with files.open_output_stream(f"{at}/{name}.rows") as f:
            for b in batches:
                column = b.column(b.schema.names.index("vector") if "vector" in b.schema.names else b.num_columns - 1)
                sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False)) if len(column) else np.empty(0)
                if column.null_count or len(sizes) > 1 or (len(sizes) and columns not in (None, int(sizes[0]))):
                    raise ValueError("vectors of one length are written, none of them null")
                if len(sizes):
                    columns = int(sizes[0])
                f.write(column.flatten().to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
                rows += len(column)
        # the header has the number of rows, so it is known last
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(np.dtype(self.kind)), "fortran_order": False, "shape": (rows, columns or 0)})
        with files.open_output_stream(f"{at}/{name}") as out, files.open_input_stream(f"{at}/{name}.rows") as body:
            out.write(head.getvalue())
            while chunk := body.read(1 << 22):
                out.write(chunk)
        files.delete_file(f"{at}/{name}.rows")
        return Written(place, name, rows, columns or 0)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        done = sorted((m for m in messages if m and m.rows), key=lambda m: m.place)
        if len({m.columns for m in done}) > 1:
            self.abort(messages)
            raise ValueError("vectors of one length are written")
        old = {x.path for x in files.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".npy")} if self.overwrite else set()
        names = []
        for i, m in enumerate(done):
            name = f"part-{self.job}-{i:05}.npy"
            files.move(f"{at}/{m.name}", f"{at}/{name}")
            names.append(name)
        if not self.overwrite and files.get_file_info(f"{at}/{LIST}").type == fs.FileType.File:
            with files.open_input_stream(f"{at}/{LIST}") as f:
                names = json.loads(f.read()) + names
        with files.open_output_stream(f"{at}/{LIST}") as f:
            f.write(json.dumps(names).encode())
        for path in old:
            files.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                files.delete_file(x.path)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row bigint, vector array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def registered(spark):
    """The session, which knows the format `npy`."""
    spark.dataSource.register(NpySource)
    return spark
