"""Scans of a database: KEYS by glob, SCAN by pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import glob_match
from .keyspace import CommandError, live

#: SCAN counts its entries by this many leading bits of their hashes.
STRETCH_BITS = 12


def keys(ks: DataFrame, db: int, pattern: str, as_of: int, compat: bool = False, include_expired: bool = False) -> DataFrame:
    """KEYS: (key) that match a glob, in no order. A plain beginning of the pattern reaches the scan as a filter."""
    return live(ks, as_of, include_expired).where((F.col("db") == db) & glob_match(F.col("key"), pattern, compat)).select("key")


def scan(ks: DataFrame, db: int, cursor: tuple[int, str] | None, as_of: int, match: str | None = None, count: int | None = 10_000, type_: str | None = None, until: tuple[int, str] | None = None) -> DataFrame:
    """SCAN: one page, (hash, key) in the order of a hash of the key, of ``count`` entries that come after ``cursor``.

    The cursor of the next page is the last row of this one; an empty page ends. Entries that are not written in between
    come exactly once. MATCH is applied to the page, so a page may be short before the end.

    ``until`` is the last (hash, key) that a page may hold, and with a count of None a page has every entry up to it, in no
    order: pages between bounds that are known beforehand need neither a sort nor one another.
    """
    if type_ is not None:
        raise CommandError("ERR the TYPE parameter is not yet supported")
    if count is not None and count <= 0:
        raise CommandError("ERR syntax error")
    rows = live(ks, as_of).where(F.col("db") == db).select(F.xxhash64("key").alias("hash"), "key")
    if cursor is not None:
        h, k = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("hash") > h) | ((F.col("hash") == h) & (F.col("key") > k)))
    if until is not None:
        h, k = F.lit(until[0]), F.lit(until[1])
        rows = rows.where((F.col("hash") < h) | ((F.col("hash") == h) & (F.col("key") <= k)))
    page = rows if count is None else rows.orderBy("hash", "key").limit(count)
    return page if match is None else page.withColumn("matches", glob_match(F.col("key"), match))


def scan_pages(ks: DataFrame, db: int, as_of: int, match: str | None = None, count: int = 10_000, type_: str | None = None) -> DataFrame:
    """Every page of SCAN by cursors in one plan: (page, cursor, keys), one row for each page from 0 on. ``cursor`` is the last
    (hash, key) of the page, from which the next one goes on, and ``keys`` are those that match, in the order of SCAN.

    A key's rank is the number of entries in the stretches of hashes before its own and its place inside the stretch, so no
    page waits for the one before it. Hashes spread evenly: a stretch, sorted in one task, is a 4,096th of the entries,
    and the sum over stretches, which one task makes, has 4,096 rows at most.
    """
    if count <= 0:
        raise CommandError("ERR syntax error")
    rows = scan(ks, db, None, as_of, match, None, type_).withColumn("stretch", F.shiftright("hash", 64 - STRETCH_BITS).cast("int"))
    sizes = rows.groupBy("stretch").agg(F.count("*").alias("n"))
    before = sizes.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy("hash", "key")) - 1
    ranked = rows.withColumn("place", place).join(F.broadcast(before), "stretch")
    entry = F.struct("hash", "key")
    found = F.collect_list(entry if match is None else F.when(F.col("matches"), entry))
    pages = ranked.groupBy(F.floor((F.col("before") + F.col("place")) / count).alias("page")).agg(F.max(entry).alias("cursor"), found.alias("found"))
    return pages.select("page", "cursor", F.transform(F.array_sort("found"), lambda x: x["key"]).alias("keys"))


def scan_all(ks: DataFrame, db: int, as_of: int, match: str | None = None, count: int = 10_000, type_: str | None = None):
    """Every page of SCAN as a list of keys; what a client reads with cursors."""
    for r in scan_pages(ks, db, as_of, match, count, type_).orderBy("page").toLocalIterator():
        yield r["keys"]
