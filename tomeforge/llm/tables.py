"""Reading input tables and writing intermediate ones."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Rows and bytes of an Arrow batch at most, so that neither side of a Python task holds much text at once.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that tables go to, the innermost last; none: the shared folder itself.
_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is set only in local mode, and where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = context.get() if context.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tomeforge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back with its schema."""
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table, or a folder of tables, that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go to a folder of their own, which is deleted at the end."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.pop()
        removed(spark, path)


def _give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow in batches of a bounded size; the session keeps the bound for what comes after.

    Workers are used again by later stages, so each task gives back what it has freed.
    """

    def task(batches):
        yield from run(batches)
        _give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(task, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as keep it apart from df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, keep: list[str], added: str) -> StructType:
    """The schema of the columns `keep` with more fields, given as DDL."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(added).fields])
