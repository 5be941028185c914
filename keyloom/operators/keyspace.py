"""The keyspace: one row per entry, unique by db and key."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "db int, key string, value binary, expiry_ms long, created_ms long, last_access_ms long, accesses long"
COLUMNS = ["db", "key", "value", "expiry_ms", "created_ms", "last_access_ms", "accesses"]
#: Keys that are empty or longer than this many bytes are refused.
MAX_KEY_BYTES = 8192
#: Logical databases.
MAX_DATABASES = 16


class Outcome(NamedTuple):
    """What a batch of writes leaves and answers: ``keyspace`` (COLUMNS), ``replies`` (seq, db, key and the reply's columns)."""

    keyspace: DataFrame
    replies: DataFrame


class CommandError(ValueError):
    """A command that is refused; the text is what a client would read."""


def keyspace(rows: DataFrame, db: int | Column, key: Column, value: Column, expiry_ms: Column | None = None, created_ms: Column | None = None, last_access_ms: Column | None = None, accesses: Column | None = None) -> DataFrame:
    """Entries made from the rows of a table; times that are not given are 0."""
    zero = F.lit(0)
    return rows.select(
        (db if isinstance(db, Column) else F.lit(select_db(db))).cast("int").alias("db"),
        key.cast("string").alias("key"),
        value.cast("binary").alias("value"),
        *[(zero if c is None else c).cast("long").alias(n) for c, n in ((expiry_ms, "expiry_ms"), (created_ms, "created_ms"), (last_access_ms, "last_access_ms"), (accesses, "accesses"))],
    )


def select_db(db: int) -> int:
    """``db`` if there is such a database."""
    if not 0 <= db < MAX_DATABASES:
        raise CommandError("ERR invalid DB index")
    return db


def live(ks: DataFrame, as_of: int | Column, include_expired: bool = False) -> DataFrame:
    """Entries that have not expired at ``as_of`` (epoch ms); with ``include_expired`` those that linger, too."""
    if include_expired:
        return ks
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("long")
    return ks.where((F.col("expiry_ms") == 0) | (now <= F.col("expiry_ms")))


def seeded(seed: int) -> Column:
    """An order of keys as good as random, the same for the same seed."""
    return F.md5(F.concat("key", F.lit(f":{seed}")))


def upsert(ks: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``ks`` with the entries ``new`` (unique keys) instead of its own, and without the keys ``gone``.

    A key that both name is written. The keyspace is read in passing: its entries that are not named stay, which takes no
    shuffle of it where the named keys are few enough for Spark to broadcast them.
    """
    named = new.select("db", "key")
    if gone is not None:
        named = named.union(gone.select("db", "key"))
    return ks.join(named, ["db", "key"], "left_anti").select(*COLUMNS).union(new.select(*COLUMNS))


def check_keys(batch: DataFrame) -> DataFrame:
    """``batch`` with ``error`` for keys that are null, empty or too long; such rows do nothing."""
    size = F.octet_length("key")
    return batch.withColumn("error", F.when(F.col("key").isNull() | (size == 0), F.lit("ERR the key cannot be empty")).when(size > MAX_KEY_BYTES, F.lit(f"ERR the key has exceeded the allowed size of '{MAX_KEY_BYTES}'")))
