"""Expiry: changing and telling when entries go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .keyspace import COLUMNS, CommandError, Outcome
from .writes import by_key, one_per_key, with_entries


def _rules(condition: str | None, before: WindowSpec) -> tuple[Column, Column]:
    """Whether a row with a later moment sets it, and whether one with a moment that is over does, if its key is there.

    ``before`` is a key's earlier rows. Of them all that matters is the first (NX), the latest moment (GT) and the earliest
    one (LT), whether they were set or not.
    """
    old, new = F.col("old_expiry"), F.col("new")
    first = F.count(F.when(F.col("amount") > 0, 1)).over(before) == 0
    most, least = F.max("moment").over(before), F.min("moment").over(before)
    rules = {
        None: (F.lit(True), F.lit(True)),
        "NX": ((old == 0) & first,) * 2,
        "XX": (old != 0,) * 2,
        "GT": ((old != 0) & (new > F.greatest(old, most)), F.lit(False)),
        "LT": (F.coalesce(new < F.least(F.when(old != 0, old), least), F.lit(True)), F.lit(True)),
    }
    if condition not in rules:
        raise CommandError("ERR syntax error")
    return rules[condition]


def _expire(ks: DataFrame, batch: DataFrame, as_of: int, condition: str | None, unit: int, relative: bool) -> Outcome:
    """``batch``: seq, db, key, amount. An amount of 0 or less deletes the key. A key's commands follow each other: after one
    that deletes it, or sets a moment before ``as_of``, the next ones find no entry."""
    base = F.lit(as_of if relative else 0).cast("long")
    before = by_key().rowsBetween(Window.unboundedPreceding, -1)
    rows = with_entries(ks, batch, as_of).withColumn("new", base + F.col("amount") * unit)
    rows = rows.withColumn("moment", F.when(F.col("amount") > 0, F.col("new")))
    sets, ends = _rules(condition, before)
    rows = rows.withColumn("ends", F.coalesce((F.col("amount") <= 0) | (F.col("new") < as_of) & ends, F.lit(False))).withColumn("sets", F.coalesce(sets, F.lit(False)))
    there = F.col("old_found").isNotNull() & ~F.coalesce(F.max("ends").over(before), F.lit(False))
    rows = rows.withColumn("done", there & (F.col("ends") | F.col("sets")))
    replies = rows.select("seq", "db", "key", F.col("done").cast("long").alias("reply_int"))
    change = one_per_key(rows.where("done"), F.desc("seq")).select("db", "key", (F.col("amount") <= 0).alias("drop_"), F.col("new").alias("new_"))
    after = ks.join(change, ["db", "key"], "left").where(~F.coalesce("drop_", F.lit(False))).withColumn("expiry_ms", F.coalesce("new_", "expiry_ms")).select(*COLUMNS)
    return Outcome(after, replies)


def expire(ks: DataFrame, batch: DataFrame, as_of: int, condition: str | None = None) -> Outcome:
    """EXPIRE: amount in seconds from ``as_of``; reply_int is 1 if the key was changed."""
    return _expire(ks, batch, as_of, condition, 1000, True)


def pexpire(ks: DataFrame, batch: DataFrame, as_of: int, condition: str | None = None) -> Outcome:
    """PEXPIRE: amount in milliseconds from ``as_of``."""
    return _expire(ks, batch, as_of, condition, 1, True)


def expireat(ks: DataFrame, batch: DataFrame, as_of: int, condition: str | None = None) -> Outcome:
    """EXPIREAT: amount as epoch seconds; one in the past is stored, and the entry is no longer seen."""
    return _expire(ks, batch, as_of, condition, 1000, False)


def pexpireat(ks: DataFrame, batch: DataFrame, as_of: int, condition: str | None = None) -> Outcome:
    """PEXPIREAT: amount as epoch milliseconds."""
    return _expire(ks, batch, as_of, condition, 1, False)


def persist(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """PERSIST: reply_int is 1 if an expiry was taken away."""
    rows = with_entries(ks, batch, as_of).withColumn("nth", F.row_number().over(by_key()))
    had = F.coalesce(F.col("old_expiry") != 0, F.lit(False)) & (F.col("nth") == 1)
    replies = rows.select("seq", "db", "key", had.cast("long").alias("reply_int"))
    change = rows.where(had).select("db", "key").distinct().withColumn("clear", F.lit(True))
    after = ks.join(change, ["db", "key"], "left").withColumn("expiry_ms", F.when(F.col("clear"), F.lit(0).cast("long")).otherwise(F.col("expiry_ms"))).select(*COLUMNS)
    return Outcome(after, replies)


def _told(ks: DataFrame, batch: DataFrame, as_of: int, value: Column) -> DataFrame:
    rows = with_entries(ks, batch, as_of)
    reply = F.when(F.col("old_found").isNull(), -2).when(F.col("old_expiry") == 0, -1).otherwise(value)
    return rows.select("seq", "db", "key", reply.cast("long").alias("reply_int"))


def ttl(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """TTL: seconds left, rounded up; -1 without expiry, -2 without entry."""
    return _told(ks, batch, as_of, F.ceil((F.col("old_expiry") - as_of) / 1000))


def pttl(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """PTTL: milliseconds left."""
    return _told(ks, batch, as_of, F.col("old_expiry") - as_of)


def expiretime(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """EXPIRETIME: the expiry in epoch seconds, rounded down."""
    return _told(ks, batch, as_of, F.floor(F.col("old_expiry") / 1000))


def pexpiretime(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """PEXPIRETIME: the expiry in epoch milliseconds."""
    return _told(ks, batch, as_of, F.col("old_expiry"))
