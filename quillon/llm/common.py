"""Reading tables, and Arrow batches in and out of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.tables import shared_folder, written  # noqa: F401

#: An output batch is closed when it holds about so many bytes, or so many rows.
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """Asked for on the driver; tasks get it with their code."""
    return to_arrow_schema(_parse_datatype_string(ddl))


def arrow_rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema, per_row: Callable[..., Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that per_row(*values) yields for each input row."""
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            values = [c[i].as_py() for c in batch.columns]
            out.extend(per_row(*values))
            size += sum(len(v) for v in values if isinstance(v, str))
            if size >= FLUSH_BYTES or len(out) >= FLUSH_ROWS:
                yield to_batch(out, schema)
                out, size = [], 0
    if out:
        yield to_batch(out, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def map_rows(df: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """df's columns through make()(*values), one Arrow batch at a time. make runs once a task, where it may load a model."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_rows(batches, schema, make())

    return df.select(*columns).mapInArrow(run, ddl)


def ordered(df: DataFrame, ddl: str, run: Callable[[Iterator[tuple]], Iterable[tuple]], rows_out: int = 1000) -> DataFrame:
    """All rows of each partition, in their order, through one generator that yields the rows of ddl."""
    schema = arrow_schema(ddl)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        for row in run(rows):
            out.append(row)
            if len(out) >= rows_out:
                yield to_batch(out, schema)
                out = []
        if out:
            yield to_batch(out, schema)

    return df.mapInArrow(go, ddl)
