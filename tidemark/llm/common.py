"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # of sessions without a shared folder, as in tests: application to folder


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


_staged: list[str] = []  # paths of all tables of ``stage``, in order


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back (survives lost executors).

    ``rows`` caps the rows of the Arrow batches of this job alone: whole texts in batches of the
    session's size (10,000) take hundreds of MB in every task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(ROWS)
    if rows:
        spark.conf.set(ROWS, str(rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ROWS, before)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Give disk back in mid-job: delete tables of ``stage`` that nothing reads any more, and let the driver's
    garbage collector notice the shuffles of finished jobs, whose files Spark then removes."""
    _delete(spark, [df.staged_at for df in staged])
    for _ in range(2):  # what Python lets go of first reaches the driver's JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def settled(make: Callable[[], DataFrame], name: str, rows: int | None = None) -> DataFrame:
    """Write what ``make`` returns, then delete the tables that it staged on the way."""
    before = len(_staged)
    out = stage(make(), name, rows)
    own = _staged[before:-1]
    del _staged[before:-1]
    _delete(out.sparkSession, own)
    release(out.sparkSession)
    return out


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting the rows of an already written table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def crc_fold(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the contract's fold number."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def one_blas_thread() -> None:
    """Keep numpy's matrix products on the task's own core: Spark already runs a worker per core,
    and a forked worker must not wait for threads that its parent had."""
    import ctypes

    import numpy  # noqa: F401  loads the library

    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
