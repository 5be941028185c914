"""Counters: numbers kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import decimal_text, parse_decimal, parse_int
from .keyspace import COLUMNS, Outcome, upsert
from .writes import by_key, fresh, one_per_key, with_entries

NOT_INTEGER = "ERR value is not an integer or out of range"
OVERFLOW = "ERR increment or decrement would overflow"
NOT_FLOAT = "ERR value is not a valid float"
_LEAST, _MOST = -(2**63), 2**63 - 1


def incrby(ks: DataFrame, batch: DataFrame, as_of: int, sign: int = 1) -> Outcome:
    """INCRBY (DECRBY with ``sign`` -1): ``batch`` also has num (long). reply_int is the number after each command.

    A missing key counts from 0; a value that is no integer is an error, and so is a step that leaves 64 bits; the next one
    goes on from the number before it. The expiry stays. Sums are taken in decimals, so none wraps round; the keys whose sum
    leaves 64 bits somewhere are done step by step.
    """
    from .fold import fold

    rows = with_entries(ks, batch, as_of)
    base = F.when(F.col("old_found").isNull(), F.lit(0).cast("long")).otherwise(parse_int(F.col("old_value")))
    step = F.col("num").cast("decimal(28,0)") * sign
    rows = rows.withColumn("base", base).withColumn("total", base.cast("decimal(28,0)") + F.sum(step).over(by_key()))
    fine = F.col("total").between(F.lit(_LEAST).cast("decimal(28,0)"), F.lit(_MOST).cast("decimal(28,0)"))
    rows = rows.withColumn("far", F.max(~fine).over(Window.partitionBy("db", "key")))
    plain, far = rows.where("not coalesce(far, false)"), rows.where("far")
    error = F.when(F.col("base").isNull(), NOT_INTEGER)
    replies = plain.select("seq", "db", "key", F.col("total").cast("long").alias("reply_int"), error.alias("error"))
    new = one_per_key(plain.where("total is not null"), F.desc("seq"))
    new = fresh(new, F.col("total").cast("long").cast("string").cast("binary"), F.coalesce("old_expiry", F.lit(0)), as_of)
    log = far.select("seq", F.lit(as_of).cast("long").alias("ts_ms"), "db", F.lit("INCRBY" if sign > 0 else "DECRBY").alias("op"), "key", F.lit(None).cast("binary").alias("arg"), F.col("num").cast("string").alias("num"), F.lit(None).cast("long").alias("ttl_ms"), F.create_map().cast("map<string,string>").alias("opts"))
    keys = log.select("db", "key").distinct()
    steps = fold(ks.join(keys, ["db", "key"], "left_semi"), log)
    return Outcome(upsert(ks, new.union(steps.keyspace.select(*COLUMNS)), keys), replies.union(steps.replies.select("seq", "db", "key", "reply_int", "error")))


def decrby(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """DECRBY."""
    return incrby(ks, batch, as_of, -1)


def incr(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """INCR."""
    return incrby(ks, batch.withColumn("num", F.lit(1).cast("long")), as_of)


def decr(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """DECR."""
    return incrby(ks, batch.withColumn("num", F.lit(1).cast("long")), as_of, -1)


def incrbyfloat(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """INCRBYFLOAT: ``batch`` also has num (decimal); reply_bytes is the number's text after each command.

    Numbers are decimals of 30 digits, 17 of them after the point; whole numbers are stored without a point.
    """
    rows = with_entries(ks, batch, as_of)
    base = F.when(F.col("old_found").isNull(), F.lit(0).cast("decimal(30,17)")).otherwise(parse_decimal(F.col("old_value")))
    total = (base + F.sum(F.col("num").cast("decimal(28,17)")).over(by_key())).cast("decimal(38,17)")
    rows = rows.withColumn("base", base).withColumn("text", decimal_text(total))
    error = F.when(F.col("base").isNull(), NOT_FLOAT)
    replies = rows.select("seq", "db", "key", F.col("text").cast("binary").alias("reply_bytes"), error.alias("error"))
    new = one_per_key(rows.where("text is not null"), F.desc("seq"))
    return Outcome(upsert(ks, fresh(new, F.col("text").cast("binary"), F.coalesce("old_expiry", F.lit(0)), as_of)), replies)
