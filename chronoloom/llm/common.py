"""Helpers shared by the text operators: shared storage, batch bounds, words."""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch. Texts may be long, so batches stay small.
ARROW_ROWS = 512

_scratch: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for any executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only where the setting is missing and Spark
    runs on this machine alone, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    if not _scratch:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back. The
    shuffle files behind it go as soon as it is there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables written in the block are removed at its end, except those that the
    frames put into the list read."""
    kept: list[DataFrame] = []
    begin = len(_scratch)
    yield kept
    read = {os.path.basename(os.path.dirname(f)) for df in kept for f in df.inputFiles()}
    for spark, path in _scratch[begin:]:
        if os.path.basename(path) not in read:
            drop_path(spark, path)
            _scratch.remove((spark, path))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def one_blas_thread() -> None:
    """Keep numpy's own OpenBLAS, if that is what it uses, from running threads
    beside Spark's tasks: on small matrices they cost processor time only."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of words in a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; a null id hashes as ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
