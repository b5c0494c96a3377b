"""Tables written on the way: they cut lineage, survive lost executors, and are read the same by every reader."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # of local sessions without a shared folder, as in tests: application to folder
_written: dict[str, list[str]] = {}  # application to its tables


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return f"{base.rstrip('/')}/tidemark-{app}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def settled(df: DataFrame, name: str, *read: DataFrame) -> DataFrame:
    """``staged``; then the staged tables ``read``, which nothing may read any more, and the shuffles of finished jobs are given back."""
    out, spark = staged(df, name), df.sparkSession
    done = [r.staged_at for r in read]
    _delete(spark, done)
    written = _written[spark.sparkContext.applicationId]
    written[:] = [p for p in written if p not in done]
    for _ in range(2):  # what Python lets go of first reaches the driver's JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; frames that read them can't be used afterwards."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))
