"""Counters of databases and of the servers' workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a worker, by the names under which they are told.
WORKER_COUNTERS = ["network_received_packets", "network_received_data", "network_sent_packets", "network_sent_data", "network_accepted_connections", "network_active_connections", "network_accepted_tls_connections", "network_active_tls_connections", "storage_written_data", "storage_write_iops", "storage_read_data", "storage_read_iops", "storage_open_files"]


def sizes(ks: DataFrame, per_db: bool = True) -> DataFrame:
    """keys_count and data_size (bytes of values), for each database or of all."""
    aggs = [F.count("*").alias("keys_count"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("data_size")]
    return ks.groupBy("db").agg(*aggs) if per_db else ks.agg(*aggs)


def change_volume(changes: DataFrame) -> DataFrame:
    """keys_changed and data_changed for each database from (db, written_bytes, deleted_bytes) of each write or delete:
    a write counts its new size, a delete the old one; neither ever falls."""
    size = F.coalesce("written_bytes", F.lit(0)) + F.coalesce("deleted_bytes", F.lit(0))
    return changes.groupBy("db").agg(F.count("*").alias("keys_changed"), F.sum(size).cast("long").alias("data_changed"))


def rollup(metrics: DataFrame, counters: list[str] | None = None) -> DataFrame:
    """Sums of each worker's counters, and of all under the worker ``aggregated``; one pass with grouping sets."""
    names = counters or WORKER_COUNTERS
    sums = metrics.rollup("worker").agg(*[F.sum(c).cast("long").alias(c) for c in names], F.grouping("worker").alias("all_"))
    return sums.select(F.when(F.col("all_") == 1, "aggregated").otherwise(F.col("worker")).alias("worker"), *names)


def exposition(rolled: DataFrame, prefix: str = "", labels: dict[str, str] | None = None, counters: list[str] | None = None) -> DataFrame:
    """The text form of rolled counters, a line for each worker and counter: ``name{worker="0",...} value``."""
    names = counters or WORKER_COUNTERS
    extra = "".join(f',{k.lower()}="{v}"' for k, v in sorted((labels or {}).items()))
    long = rolled.select("worker", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("m"))
    return long.select(F.concat(F.lit(prefix), F.col("m.name"), F.lit('{worker="'), F.col("worker"), F.lit(f'"{extra}}} '), F.col("m.value").cast("string")).alias("line"))
