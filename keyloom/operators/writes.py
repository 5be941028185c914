"""Writes: batches of commands against the keyspace. A batch has seq (its order), db, key and arguments.

A key that a batch names several times gets its commands in the order of seq. Each function gives the keyspace after the
batch and the replies. Keys of the keyspace are joined once and written once, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import overlay_bytes
from .keyspace import COLUMNS, CommandError, Outcome, live, upsert


def by_key(*order: str | Column) -> WindowSpec:
    """A key's commands in their order."""
    return Window.partitionBy("db", "key").orderBy(*(order or ("seq",)))


def with_entries(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """The batch with old_value, old_expiry and old_found of each key's live entry.

    The entries that the batch names are picked first, so the keyspace is not shuffled for a batch that Spark can broadcast.
    """
    entries = live(ks, as_of).join(batch.select("db", "key"), ["db", "key"], "left_semi")
    entries = entries.select("db", "key", F.col("value").alias("old_value"), F.col("expiry_ms").alias("old_expiry"), F.lit(True).alias("old_found"))
    return batch.join(entries, ["db", "key"], "left")


def one_per_key(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The first row of each key in an order; every task keeps its own first rows before they are dealt out."""
    return rows.withColumn("nth_", F.row_number().over(by_key(*order))).where("nth_ = 1").drop("nth_")


def enforce_ttl(expiry_ms: Column, as_of: int, default_ttl_ms: int | None = None, max_ttl_ms: int | None = None) -> Column:
    """An expiry under the server's limits: none becomes the default, if there is one; a later one than allowed is cut."""
    now = F.lit(as_of).cast("long")
    out = expiry_ms
    if default_ttl_ms:
        out = F.when(out == 0, now + default_ttl_ms).otherwise(out)
    if max_ttl_ms:
        out = F.when(out == 0, out if not default_ttl_ms else now + max_ttl_ms).otherwise(F.least(out, now + max_ttl_ms))
    return out


def fresh(rows: DataFrame, value: str | Column, expiry_ms: Column, as_of: int) -> DataFrame:
    """Entries as a write at ``as_of`` makes them."""
    now = F.lit(as_of).cast("long")
    return rows.select("db", "key", (F.col(value) if isinstance(value, str) else value).alias("value"), expiry_ms.cast("long").alias("expiry_ms"), now.alias("created_ms"), now.alias("last_access_ms"), F.lit(0).cast("long").alias("accesses")).select(*COLUMNS)


def absolute_expiry(command: str, as_of: int, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None) -> int:
    """The absolute expiry of EX, PX, EXAT and PXAT, the last given of these in this order; 0 without any."""
    given = [(pxat, 1, 0), (exat, 1000, 0), (px, 1, as_of), (ex, 1000, as_of)]
    for amount, unit, base in given:
        if amount is not None:
            if amount <= 0:
                raise CommandError(f"ERR invalid expire time in '{command}' command")
            return base + amount * unit
    return 0


def set_(ks: DataFrame, batch: DataFrame, as_of: int, *, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None, keepttl: bool = False, condition: str | None = None, get: bool = False, default_ttl_ms: int | None = None, max_ttl_ms: int | None = None, order: tuple[str, ...] = ("seq",)) -> Outcome:
    """SET: ``batch`` also has value. Replies: applied, and reply_bytes: ``OK`` or null, with ``get`` the value before.

    A key's commands follow each other by ``order``. One whose expiry lies before ``as_of`` leaves an entry that the next
    does not see.
    """
    if condition not in (None, "NX", "XX"):
        raise CommandError("ERR syntax error")
    expiry = absolute_expiry("set", as_of, ex, px, exat, pxat)
    if expiry and keepttl:
        raise CommandError("ERR syntax error")
    unseen = 0 < expiry < as_of
    base = with_entries(ks, batch, as_of).withColumn("had", F.coalesce("old_found", F.lit(False)))
    rows = base.withColumn("nth", F.row_number().over(by_key(*order)))
    first = F.lit(True) if unseen and condition == "NX" else F.col("nth") == 1
    applied = F.lit(True) if condition is None else ~F.col("had") & first if condition == "NX" else F.col("had") & (first if unseen else F.lit(True))
    rows = rows.withColumn("applied", applied)
    earlier = F.last(F.when(F.col("applied"), F.col("value")), True).over(by_key(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.when(F.col("nth") == 1, F.col("old_value")) if unseen else F.coalesce(earlier, F.col("old_value"))
    reply = before if get else F.when(F.col("applied"), F.lit(b"OK"))
    replies = rows.select("seq", "db", "key", "applied", reply.alias("reply_bytes"))
    if condition:
        base = base.where(~F.col("had") if condition == "NX" else F.col("had"))
    first_counts = condition == "NX" and not unseen or condition == "XX" and unseen
    last = one_per_key(base, *[F.col(c) if first_counts else F.col(c).desc() for c in order])
    at = F.coalesce(F.col("old_expiry"), F.lit(0).cast("long")) if keepttl else F.lit(expiry).cast("long")
    return Outcome(upsert(ks, fresh(last, "value", enforce_ttl(at, as_of, default_ttl_ms, max_ttl_ms), as_of)), replies)


def _flag(outcome: Outcome) -> Outcome:
    return Outcome(outcome.keyspace, outcome.replies.select("seq", "db", "key", F.col("applied").cast("long").alias("reply_int")))


def setnx(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """SETNX: reply_int is 1 if the key was made, else 0."""
    return _flag(set_(ks, batch, as_of, condition="NX"))


def setex(ks: DataFrame, batch: DataFrame, as_of: int, seconds: int) -> Outcome:
    """SETEX."""
    if seconds <= 0:
        raise CommandError("ERR invalid expire time in 'setex' command")
    return set_(ks, batch, as_of, ex=seconds)


def psetex(ks: DataFrame, batch: DataFrame, as_of: int, millis: int) -> Outcome:
    """PSETEX."""
    if millis <= 0:
        raise CommandError("ERR invalid expire time in 'psetex' command")
    return set_(ks, batch, as_of, px=millis)


def getset(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """GETSET: reply_bytes is the value before; the key loses its expiry."""
    return set_(ks, batch, as_of, get=True)


def mset(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """MSET: ``batch`` has a row for each key and value, pos being their order; of equal keys the last wins."""
    out = set_(ks, batch, as_of, order=("seq", "pos"))
    return Outcome(out.keyspace, batch.select("seq", "db").distinct().withColumn("reply_bytes", F.lit(b"OK")))


def msetnx(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """MSETNX: ``batch`` has a row for each key and value. A command writes all of its keys, reply_int 1, or if one exists
    none, reply_int 0. Commands that share a key follow each other."""

    def alone(batch: DataFrame) -> Outcome:
        rows = with_entries(ks, batch, as_of)
        verdict = rows.groupBy("seq", "db").agg((F.count("old_found") == 0).alias("applied"))
        new = one_per_key(rows.join(verdict, ["seq", "db"]).where("applied"), F.desc("seq"), F.desc("pos"))
        return Outcome(upsert(ks, fresh(new, "value", F.lit(0), as_of)), verdict.select("seq", "db", F.col("applied").cast("long").alias("reply_int")))

    log = batch.select("seq", "db", "key", F.lit("MSETNX").alias("op"), F.col("value").alias("arg"), F.lit(None).cast("string").alias("dst"))
    return across_keys(ks, batch, log, as_of, alone, ["seq", "db", "reply_int"])


def delete(ks: DataFrame, batch: DataFrame, as_of: int, include_expired: bool = False) -> Outcome:
    """DEL and UNLINK: ``batch`` has a row for each key; reply_int counts keys deleted, each in the first command that names it."""
    first = batch.groupBy("db", "key").agg(F.min("seq").alias("seq"))
    hit = first.join(live(ks, as_of, include_expired).select("db", "key"), ["db", "key"], "left_semi")
    counts = batch.select("seq", "db").distinct().join(hit.groupBy("seq", "db").agg(F.count("*").alias("n")), ["seq", "db"], "left")
    gone = ks.join(batch.select("db", "key").distinct(), ["db", "key"], "left_anti")
    return Outcome(gone, counts.select("seq", "db", F.coalesce("n", F.lit(0)).cast("long").alias("reply_int")))


unlink = delete


def getdel(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """GETDEL: the first command on a key gets its value, later ones null."""
    rows = with_entries(ks, batch, as_of).withColumn("nth", F.row_number().over(by_key()))
    replies = rows.select("seq", "db", "key", F.when(F.col("nth") == 1, F.col("old_value")).alias("reply_bytes"))
    return Outcome(ks.join(batch.select("db", "key").distinct(), ["db", "key"], "left_anti"), replies)


def getex(ks: DataFrame, batch: DataFrame, as_of: int, *, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None, persist: bool = False) -> Outcome:
    """GETEX: values, and a new expiry (or none with ``persist``) for the keys found. A missing key is null before a bad
    expiry is looked at, so that is only an error (column ``error``) where the key is found."""
    now = F.lit(as_of).cast("long")
    error, at = None, None
    try:
        at = absolute_expiry("getex", as_of, ex, px, exat, pxat)
    except CommandError as e:
        error = str(e)
    rows = with_entries(ks, batch, as_of).withColumn("nth", F.row_number().over(by_key()))
    unseen = at is not None and 0 < at < as_of  # the next command on the key does not see it
    found = F.col("old_found").isNotNull() & (F.col("nth") == 1 if unseen else F.lit(True))
    value = F.lit(None).cast("binary") if error else F.when(found, F.col("old_value"))
    replies = rows.select("seq", "db", "key", value.alias("reply_bytes"), (F.when(found, F.lit(error)) if error else F.lit(None).cast("string")).alias("error"))
    if error or not (persist or at):
        return Outcome(ks, replies)
    named = batch.select("db", "key").distinct().withColumn("named", F.lit(True))
    alive = (F.col("expiry_ms") == 0) | (now <= F.col("expiry_ms"))
    expiry = F.when(F.col("named") & alive, F.lit(0 if persist else at).cast("long")).otherwise(F.col("expiry_ms"))
    return Outcome(ks.join(named, ["db", "key"], "left").withColumn("expiry_ms", expiry).select(*COLUMNS), replies)


def append(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """APPEND: reply_int is the length in bytes after each command; the expiry stays."""
    rows = with_entries(ks, batch, as_of)
    total = F.sum(F.octet_length("value")).over(by_key())
    replies = rows.select("seq", "db", "key", (F.coalesce(F.octet_length("old_value"), F.lit(0)) + total).cast("long").alias("reply_int"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    new = rows.groupBy("db", "key").agg(F.first("old_value").alias("old"), F.first("old_expiry").alias("at"), parts.alias("parts"))
    joined = F.aggregate("parts", F.coalesce("old", F.unhex(F.lit(""))), lambda a, x: F.concat(a, x["value"]))
    return Outcome(upsert(ks, fresh(new, joined, F.coalesce("at", F.lit(0)), as_of)), replies)


def setrange(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """SETRANGE: ``batch`` also has offset and value; reply_int is the new length, a negative offset an error. The key loses
    its expiry. Commands on one key follow each other."""
    rows = with_entries(ks, batch, as_of)
    ok = F.col("offset") >= 0
    steps = rows.where(ok).groupBy("db", "key").agg(F.first("old_value").alias("old"), F.array_sort(F.collect_list(F.struct("seq", "offset", "value"))).alias("steps"))
    done = F.aggregate("steps", F.coalesce("old", F.unhex(F.lit(""))), lambda a, x: overlay_bytes(a, x["offset"], x["value"]))
    need = F.when(F.octet_length("value") > 0, F.col("offset") + F.octet_length("value")).otherwise(0)
    length = F.greatest(F.coalesce(F.octet_length("old_value"), F.lit(0)), F.max(F.when(ok, need)).over(by_key()))
    replies = rows.select("seq", "db", "key", F.when(ok, length).cast("long").alias("reply_int"), F.when(~ok, "ERR offset is out of range").alias("error"))
    return Outcome(upsert(ks, fresh(steps, done, F.lit(0), as_of)), replies)


def across_keys(ks: DataFrame, batch: DataFrame, log: DataFrame, as_of: int, alone: Callable[[DataFrame], Outcome], reply: list[str]) -> Outcome:
    """A batch of commands on several keys. Those that share no key with another command are done side by side by
    ``alone``; the others follow each other by seq, dealt by the keys that they tie together.

    ``log`` has seq, db, key, op, arg and dst of the batch's rows; seq tells commands apart.
    """
    from .fold import replay

    names = log.select("seq", "db", "key").union(log.where("dst is not null").select("seq", "db", F.col("dst"))).distinct()
    tied = names.groupBy("db", "key").agg(F.count("*").alias("n")).where("n > 1")
    late = names.join(tied, ["db", "key"], "left_semi").select("seq", "db").distinct()
    if not late.limit(1).count():
        return alone(batch)
    side = alone(batch.join(late, ["seq", "db"], "left_anti"))
    rows = log.join(late, ["seq", "db"], "left_semi")
    opts = F.when(F.col("dst").isNotNull(), F.create_map(F.lit("dst"), F.col("dst"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.select("seq", F.lit(as_of).cast("long").alias("ts_ms"), "db", F.split("op", " ")[0].alias("op"), "key", "arg", F.lit(None).cast("string").alias("num"), F.lit(None).cast("long").alias("ttl_ms"), F.when(F.col("op").endswith(" REPLACE"), F.map_concat(opts, F.create_map(F.lit("REPLACE"), F.lit("1")))).otherwise(opts).alias("opts"))
    mine = names.join(late, ["seq", "db"], "left_semi").select("db", "key").distinct()
    done = replay(ks.join(mine, ["db", "key"], "left_semi"), rows)
    told = done.replies.withColumn("dst", F.col("dst"))
    return Outcome(upsert(side.keyspace, done.keyspace, mine), side.replies.select(*reply).unionByName(told.select(*reply)))


def _taken(ks: DataFrame, batch: DataFrame, as_of: int) -> DataFrame:
    """(db, dst, taken) of the destinations that a batch names and that have an entry."""
    entries = live(ks, as_of).select("db", F.col("key").alias("dst"), F.lit(True).alias("taken"))
    return entries.join(batch.select("db", "dst"), ["db", "dst"], "left_semi")


def copy(ks: DataFrame, batch: DataFrame, as_of: int, replace: bool = False) -> Outcome:
    """COPY: ``batch`` has key (from) and dst. reply_int is 1 if copied; the copy has no expiry. Commands that share a key
    follow each other."""

    def alone(batch: DataFrame) -> Outcome:
        rows = with_entries(ks, batch, as_of).join(_taken(ks, batch, as_of), ["db", "dst"], "left")
        rows = rows.withColumn("applied", F.col("old_found").isNotNull() & (F.lit(replace) | F.col("taken").isNull()))
        new = rows.where("applied").select("db", F.col("dst").alias("key"), F.col("old_value").alias("value"))
        return Outcome(upsert(ks, fresh(new, "value", F.lit(0), as_of)), rows.select("seq", "db", "key", "dst", F.col("applied").cast("long").alias("reply_int")))

    log = batch.select("seq", "db", "key", F.lit("COPY REPLACE" if replace else "COPY").alias("op"), F.lit(None).cast("binary").alias("arg"), "dst")
    return across_keys(ks, batch, log, as_of, alone, ["seq", "db", "key", "dst", "reply_int"])


def rename(ks: DataFrame, batch: DataFrame, as_of: int, if_new: bool = False) -> Outcome:
    """RENAME, and with ``if_new`` RENAMENX: ``batch`` has key (from) and dst. Commands that share a key follow each other.

    The entry moves as it is, with its expiry. A missing source is an error, except that a name that stays the same is
    answered (OK or 0) before anything is looked up.
    """

    def alone(batch: DataFrame) -> Outcome:
        same = F.col("key") == F.col("dst")
        rows = with_entries(ks, batch, as_of).join(_taken(ks, batch, as_of), ["db", "dst"], "left")
        found = F.col("old_found").isNotNull()
        free = F.col("taken").isNull() if if_new else F.lit(True)
        rows = rows.withColumn("applied", ~same & found & free)
        moves = rows.where("applied").select("db", "key", "dst")
        moved = live(ks, as_of).join(moves, ["db", "key"]).select("db", F.col("dst").alias("key"), *COLUMNS[2:])
        error = F.when(~same & ~found, "ERR no such key").alias("error")
        flag = F.when(same, 0).when(found, F.col("applied").cast("long")) if if_new else None
        reply = [flag.cast("long").alias("reply_int")] if if_new else [F.when(same | F.col("applied"), F.lit(b"OK")).alias("reply_bytes")]
        return Outcome(upsert(ks, moved, moves.select("db", "key")), rows.select("seq", "db", "key", "dst", *reply, error))

    log = batch.select("seq", "db", "key", F.lit("RENAMENX" if if_new else "RENAME").alias("op"), F.lit(None).cast("binary").alias("arg"), "dst")
    return across_keys(ks, batch, log, as_of, alone, ["seq", "db", "key", "dst", "reply_int" if if_new else "reply_bytes", "error"])


def renamenx(ks: DataFrame, batch: DataFrame, as_of: int) -> Outcome:
    """RENAMENX."""
    return rename(ks, batch, as_of, if_new=True)


def flushdb(ks: DataFrame, db: int, as_of: int, mode: str = "SYNC") -> DataFrame:
    """FLUSHDB: the keyspace without the entries of ``db`` made before ``as_of``."""
    if mode != "SYNC":
        raise CommandError("ERR the ASYNC mode is not supported")
    return ks.where((F.col("db") != db) | (F.col("created_ms") > as_of))
