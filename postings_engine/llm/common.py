"""What the operators of this package share: reading tables, the shared scratch folder, Arrow output."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a session that names
    none (tests on one machine) gets a temporary one, removed when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, in any case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, as rows here hold whole texts or arrays: bounds what a batch takes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables of one run of an operator, written to a new folder of the shared folder. A written
    table cuts the lineage: if an executor is lost, what follows starts again from the files."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        small_batches(spark)

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{name}-{self._n}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # once a table is written, nothing reads its shuffles
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, df: DataFrame) -> None:
        """Removes a saved table that nothing reads any more."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def given_back(run: Callable) -> Callable:
    """A function for mapInArrow after whose end the worker gives freed memory back to the system: workers
    are kept from task to task and from stage to stage, and so is what their allocators hold."""
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass
    return whole


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
