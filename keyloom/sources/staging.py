"""Intermediate tables where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where each staged table lies, by its folder's name: for drop_staged, and for the end of the session.
_staged: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Without one, a temporary folder serves a local session, as in tests;
    on a cluster it is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts lineage, so nothing before it is computed twice
    and lost executors cost only what follows. The table stays until drop_staged or the end of the Python session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_drop_all)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` made and that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "_keyloom_path", None)
        if path in _staged:
            delete_folder(_staged.pop(path), path)


def _drop_all() -> None:
    """What is left at the end of the session, as far as the session can still be used."""
    for path, spark in list(_staged.items()):
        try:
            delete_folder(spark, path)
        except Exception:  # the session has been stopped before
            return
        _staged.pop(path, None)
