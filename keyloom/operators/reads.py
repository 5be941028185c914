"""Reads: batches of keys against the keyspace. A batch has seq, db and key; one row is one argument of a command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import byte_slice, common_length, common_subsequence
from .keyspace import live, seeded


def _found(ks: DataFrame, batch: DataFrame, as_of: int, include_expired: bool = False) -> DataFrame:
    """Each row of the batch, in whatever number, with the entry of its key or nulls."""
    entries = live(ks, as_of, include_expired).join(batch.select("db", "key"), ["db", "key"], "left_semi").select("db", "key", "value", "expiry_ms", F.lit(True).alias("found"))
    return batch.join(entries, ["db", "key"], "left")


def get(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """GET: (seq, db, key, reply_bytes), null for a missing key."""
    return _found(ks, batch, as_of).select("seq", "db", "key", F.col("value").alias("reply_bytes"))


def mget(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """MGET: ``batch`` has seq, db and keys (an array); (seq, db, pos, key, reply_bytes) in the order of arguments,
    duplicates kept."""
    rows = batch.select("seq", "db", F.posexplode("keys").alias("pos", "key"))
    return _found(ks, rows, as_of).select("seq", "db", "pos", "key", F.col("value").alias("reply_bytes"))


def _counted(ks: DataFrame, batch: DataFrame, as_of: int, include_expired: bool) -> DataFrame:
    return _found(ks, batch, as_of, include_expired).groupBy("seq", "db").agg(F.count("found").alias("reply_int"))


def exists(ks: DataFrame, batch: DataFrame, as_of: int, include_expired: bool = False) -> DataFrame:
    """EXISTS: (seq, db, reply_int), arguments found; one given twice counts twice."""
    return _counted(ks, batch, as_of, include_expired)


def touch(ks: DataFrame, batch: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """TOUCH: (keyspace with ``as_of`` as last access of the keys, replies as of EXISTS)."""
    keys = batch.select("db", "key").distinct().withColumn("touched", F.lit(True))
    alive = (F.col("expiry_ms") == 0) | (F.lit(as_of) <= F.col("expiry_ms"))
    moved = F.when(F.col("touched") & alive, F.lit(as_of).cast("long")).otherwise(F.col("last_access_ms"))
    after = ks.join(keys, ["db", "key"], "left").select("db", "key", "value", "expiry_ms", "created_ms", moved.alias("last_access_ms"), "accesses")
    return after, _counted(ks, batch, as_of, False)


def strlen(ks: DataFrame, batch: DataFrame, as_of: int, include_expired: bool = False) -> DataFrame:
    """STRLEN: (seq, db, key, reply_int) in bytes, 0 for a missing key."""
    return _found(ks, batch, as_of, include_expired).select("seq", "db", "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("reply_int"))


def getrange(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """GETRANGE and SUBSTR: ``batch`` also has start and end; bytes of the slice, null for a missing key."""
    return _found(ks, batch, as_of).select("seq", "db", "key", byte_slice(F.col("value"), F.col("start"), F.col("end")).alias("reply_bytes"))


substr = getrange


def lcs(ks: DataFrame, batch: DataFrame, as_of: int, length_only: bool = False) -> DataFrame:
    """LCS: ``batch`` has seq, db, key and key2; (seq, db, key, key2, reply_bytes, reply_int): subsequence and its length.

    With ``length_only`` (LEN) the subsequence is not made and reply_bytes is null."""
    entries = live(ks, as_of)
    a = entries.select("db", "key", F.col("value").alias("a"))
    b = entries.select("db", F.col("key").alias("key2"), F.col("value").alias("b"))
    both = batch.join(a, ["db", "key"], "left").join(b, ["db", "key2"], "left")
    if length_only:
        return both.select("seq", "db", "key", "key2", F.lit(None).cast("binary").alias("reply_bytes"), common_length(F.col("a"), F.col("b")).alias("reply_int"))
    out = both.select("seq", "db", "key", "key2", common_subsequence(F.col("a"), F.col("b")).alias("reply_bytes"))
    return out.withColumn("reply_int", F.octet_length("reply_bytes").cast("long"))


def dbsize(ks: DataFrame, as_of: int, include_expired: bool = False) -> DataFrame:
    """DBSIZE of every database that has an entry: (db, reply_int)."""
    return live(ks, as_of, include_expired).groupBy("db").agg(F.count("*").alias("reply_int"))


def randomkey(ks: DataFrame, db: int, as_of: int, seed: int = 0) -> DataFrame:
    """RANDOMKEY: one key of the database, the same for the same seed; no row if it is empty."""
    rank = seeded(seed)
    return live(ks, as_of).where(F.col("db") == db).agg(F.min_by("key", F.struct(rank, "key")).alias("key")).where("key is not null")
