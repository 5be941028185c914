"""Replaying an ordered command log: plain plans where a key's history folds by aggregation, a sorted fold elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import answers, fold, replay

__all__ = ["answers", "append_state", "counter_replies", "counter_state", "fold", "last_write_state", "replay"]


def last_write_state(log: DataFrame) -> DataFrame:
    """(db, key, arg, seq) after SET and DEL: the last of a key's commands decides, by an aggregation with partial sums."""
    last = log.where(F.col("op").isin("SET", "DEL")).groupBy("db", "key").agg(F.max_by(F.struct("op", "arg", "seq"), "seq").alias("l"))
    return last.where("l.op = 'SET'").select("db", "key", F.col("l.arg").alias("arg"), F.col("l.seq").alias("seq"))


def counter_state(log: DataFrame) -> DataFrame:
    """(db, key, value) after SET and DEL of integers and INCRBY (num long).

    Only what follows a key's last SET or DEL counts. That point is found first, then increments after it are summed: two
    aggregations that combine within tasks, so a key with very many commands is no burden to one task.
    """
    reset = log.where(F.col("op").isin("SET", "DEL")).groupBy("db", "key").agg(F.max_by(F.struct("op", "num", "seq"), "seq").alias("r"))
    adds = log.where("op = 'INCRBY'").join(reset.select("db", "key", F.col("r.seq").alias("at")), ["db", "key"], "left")
    adds = adds.where("at is null or seq > at").groupBy("db", "key").agg(F.sum("num").alias("plus"))
    both = reset.join(adds, ["db", "key"], "full")
    # a key whose last command is DEL has no entry
    return both.where("plus is not null or r.op = 'SET'").select("db", "key", (F.when(F.col("r.op") == "SET", F.col("r.num")).otherwise(0) + F.coalesce("plus", F.lit(0))).cast("long").alias("value"))


def counter_replies(log: DataFrame) -> DataFrame:
    """(seq, db, key, value) after each SET, DEL and INCRBY: SET and DEL begin a segment, sums run inside it."""
    by_key = Window.partitionBy("db", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.where(F.col("op").isin("SET", "DEL", "INCRBY")).withColumn("segment", F.sum(F.when(F.col("op") == "INCRBY", 0).otherwise(1)).over(by_key))
    inside = Window.partitionBy("db", "key", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("seq", "db", "key", F.sum(F.when(F.col("op") == "DEL", 0).otherwise(F.col("num"))).over(inside).cast("long").alias("value"))


def append_state(log: DataFrame) -> DataFrame:
    """(db, key, value) after APPEND and DEL: parts after the last DEL, in the order of seq. A value is one row, so its
    parts are gathered in one."""
    reset = log.where("op = 'DEL'").groupBy("db", "key").agg(F.max("seq").alias("at"))
    parts = log.where("op = 'APPEND'").join(reset, ["db", "key"], "left").where("at is null or seq > at")
    gathered = parts.groupBy("db", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "arg"))).alias("parts"))
    return gathered.select("db", "key", F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["arg"])).alias("value"))
