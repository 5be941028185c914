"""Reading inputs and keeping intermediate tables where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, stage

__all__ = ["bound_batches", "drop_staged", "join_frequent", "read", "stage_table"]

#: Rows that go to a Python worker at a time; the default of ten thousand whole texts takes too much of an executor's memory.
BATCH_ROWS = 1000
#: Rows of one key that a task of a join takes; a key of more rows is dealt over several tasks.
HOT_ROWS = 20_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    return stage(df, name)


def join_frequent(rows: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``rows`` joined with ``few``, which has one row per key and in ``n`` how many of ``rows`` have that key.

    A key of more than HOT_ROWS rows (at very many rows: of more than a millionth of all) is dealt over as many tasks as it
    has such portions, by the hash of the column ``spread``. At most a million keys can have so many rows, which bounds the
    list of them that is broadcast. ``few`` is staged, as it is read more than once; ``n`` is not in the result.
    """
    few = stage_table(few, "frequent")
    most = few.agg(F.max("n"), F.sum("n")).first()
    portion = max(HOT_ROWS, -(-(most[1] or 0) // 1_000_000))
    if (most[0] or 0) <= portion:
        return rows.join(few.drop("n"), keys)
    salts = F.ceil(F.col("n") / portion).cast("int")
    hot = F.broadcast(few.where(F.col("n") > portion).select(*keys, salts.alias("salts_")))
    salted = rows.join(hot, keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(spread), "salts_"), F.lit(0)).cast("int")).drop("salts_")
    dealt = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    return salted.join(dealt, [*keys, "salt_"]).drop("salt_")
