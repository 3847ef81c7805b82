"""Places and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary one serves a driver that runs all tasks itself (tests); anything
    else has no folder that all machines see, which is an error.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="pulsegrid-shared-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the jobs within as soon as each job is done."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str | None = None, dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors. ``df`` isn't used again.
    ``codec`` is Parquet's, by default the session's; columns of hashes need no ``dictionary``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_end_here(spark):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``written`` that nothing reads any more; others are left alone."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
