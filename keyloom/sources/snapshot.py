"""Snapshots: immutable Parquet versions of the keyspace. A version counts when it is written whole, which a mark tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyspace import COLUMNS, live


def due(now_ms: int, last_ms: int, interval_ms: int, keys_changed: int, data_changed: int, min_keys: int = 0, min_data: int = 0, enabled: bool = True) -> bool:
    """Whether an automatic snapshot is due: the interval is over, and no minimum is set or one is reached."""
    if not enabled or now_ms - last_ms < interval_ms:
        return False
    return not (min_keys or min_data) or bool(min_keys and keys_changed >= min_keys) or bool(min_data and data_changed >= min_data)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions that lie in ``path``."""
    return _numbers(spark, f"{path}/_whole", "")


def current(spark: SparkSession, path: str) -> int:
    """The number of the current version: the last whole one. Readers see the one before until a new one is marked."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no whole snapshot in {path}")
    return found[-1]


def save(ks: DataFrame, path: str, as_of: int, keep: int = 3) -> int:
    """SAVE and BGSAVE: write the live entries as a new version, one folder for each db, then mark it whole, which is one
    step of the file system; only the last ``keep`` versions stay. Readers of an older version are not disturbed before it
    goes, and what a writer that failed has left is no version."""
    spark = ks.sparkSession
    number = max(_numbers(spark, path, "v="), default=0) + 1
    live(ks, as_of).select(*COLUMNS).write.partitionBy("db").parquet(f"{path}/v={number}")
    fs, at = _fs(spark, f"{path}/_whole/{number}")
    fs.create(at).close()
    for old in versions(spark, path)[: -keep or None]:
        for name in (f"_whole/{old}", f"v={old}"):
            fs, at = _fs(spark, f"{path}/{name}")
            fs.delete(at, True)
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The entries of a version, the current one by default; a filter on db reads only that database's files."""
    number = current(spark, path) if version is None else version
    rows = spark.read.schema("key string, value binary, expiry_ms long, created_ms long, last_access_ms long, accesses long, db int").parquet(f"{path}/v={number}")
    return rows.select(F.col("db"), *COLUMNS[1:])
