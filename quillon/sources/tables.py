"""Tables written between the rounds of an iteration, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query as soon as it has ended, not when its plan is collected as garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on a local master a new folder stands in where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df's rows as a table in the shared folder: cuts the lineage, and is computed once for all readers. Such tables go with the folder, which belongs to the job, or by `let_go`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def let_go(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more. What was derived from them has to be written itself."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
