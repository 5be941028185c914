"""Eviction: which entries go when a database is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .keyspace import seeded

#: Entries looked at in a sampled round, and evicted of them.
SAMPLE, ROUND = 64, 5


def pressure(used: float, soft: float, hard: float) -> float:
    """How far a size is between its soft limit (0) and its hard one (1)."""
    return 0.0 if used <= soft else 1.0 if hard <= soft else (used - soft) / (hard - soft)


def usage(ks: DataFrame) -> tuple[int, int]:
    """Entries, and bytes of their values."""
    n, size = ks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    return int(n), int(size)


def order_by(policy: str, seed: int = 0) -> Column:
    """What entries are sorted by under a policy: the smallest goes first. Entries without expiry go last under ttl."""
    return {
        "lru": F.col("last_access_ms"),
        "lfu": F.col("accesses"),
        "ttl": F.when(F.col("expiry_ms") == 0, F.lit(2**63 - 1)).otherwise(F.col("expiry_ms")),
        "random": seeded(seed),
    }[policy]


def victims(ks: DataFrame, policy: str, n: int = ROUND, only_ttl: bool = False, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(db, key, rank_by) of the ``n`` entries that go first; of equal ones the smaller key. With ``sample`` only that many
    entries, drawn by ``seed``, are looked at, as a server does that cannot sort all."""
    rows = ks.where(F.col("expiry_ms") != 0) if only_ttl else ks
    if sample is not None:
        rows = rows.orderBy(seeded(seed + 1), "db", "key").limit(sample)
    return rows.select("db", "key", order_by(policy, seed).alias("rank_by")).orderBy("rank_by", "db", "key").limit(n)


def evict(ks: DataFrame, policy: str, n: int = ROUND, only_ttl: bool = False, sample: int | None = None, seed: int = 0) -> DataFrame:
    """The keyspace without the victims of one round."""
    return ks.join(victims(ks, policy, n, only_ttl, sample, seed).select("db", "key"), ["db", "key"], "left_anti")


def evict_to(ks: DataFrame, policy: str, soft_keys: int | None = None, soft_bytes: int | None = None, only_ttl: bool = False, seed: int = 0) -> DataFrame:
    """The keyspace cut to ``soft_keys`` entries and ``soft_bytes`` bytes of values, in the policy's order and no further than
    needed; with ``only_ttl`` entries without expiry stay even so.

    Entries are ranged by the policy's order, and the counts and bytes of each range tell in which range the cut is: ranges
    before it go whole, and only that one is sorted.
    """
    n, size = usage(ks)
    keys, data = 0 if soft_keys is None else n - soft_keys, 0 if soft_bytes is None else size - soft_bytes
    if keys <= 0 and data <= 0:
        return ks
    rows = ks.where(F.col("expiry_ms") != 0) if only_ttl else ks
    rows = rows.select("db", "key", order_by(policy, seed).alias("rank_by"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("size"))
    ranged = stage(rows.repartitionByRange("rank_by", "db", "key").withColumn("range", F.spark_partition_id()), "evict")
    full, partly, above, heavy = [], [], 0, 0
    for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("range").collect():  # a row for each range
        if above + r["n"] <= keys or heavy + r["size"] <= data:
            full.append(r["range"])
        elif above < keys or heavy < data:
            partly.append((r["range"], keys - above, data - heavy))
        above, heavy = above + r["n"], heavy + r["size"]
    gone = ranged.where(F.col("range").isin(full)).select("db", "key")
    before = Window.partitionBy("range").orderBy("rank_by", "db", "key").rowsBetween(Window.unboundedPreceding, -1)
    for place, left_keys, left_bytes in partly:
        some = ranged.where(F.col("range") == place).withColumn("n", F.count("*").over(before)).withColumn("s", F.coalesce(F.sum("size").over(before), F.lit(0)))
        gone = gone.union(some.where((F.col("n") < left_keys) | (F.col("s") < left_bytes)).select("db", "key"))
    return ks.join(gone, ["db", "key"], "left_anti")
