"""Commands one after the other: a sorted fold over groups of keys that commands tie together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, stage
from .graph import components
from .keyspace import COLUMNS, Outcome
from .machine import REPLY_SCHEMA, Entry, Reply, cross, step

#: Commands that name several keys.
CROSS_KEY = ("RENAME", "RENAMENX", "COPY", "MSETNX")
#: Stretches of seq in which the last FLUSHDB before each command is looked for.
STRETCHES = 1024
_TIMES = "struct<created_ms:long,last_access_ms:long,accesses:long>"
#: What the fold gives: kind 0 is a reply, kind 1 an entry; flushed is the last FLUSHDB that an entry's group has seen.
_OUT = f"kind int, {REPLY_SCHEMA}, dst string, of string, pos int, value binary, expiry_ms long, created_ms long, last_access_ms long, accesses long, flushed long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_REPLY = [c.split()[0] for c in REPLY_SCHEMA.split(", ")] + ["dst", "of", "pos"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, seq and pos: entries first, then commands. What is held is a group's entries and one command."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in _OUT.split(", ")]
    out: list[tuple] = []
    group, state, flushed, several = None, {}, {}, []

    def answer(r: dict, reply: Reply, of: str | None = None, pos: int | None = None) -> None:
        out.append((0, r["seq"], r["db"], r["key"], *reply, r["opts"].get("dst"), of, pos, *[None] * 6))

    def together() -> None:
        """The rows of one MSETNX."""
        if several:
            answer(several[0], cross(state, "MSETNX", several[0]["db"], [(r["key"], r["arg"] or b"") for r in several], several[0]["ts_ms"], {}))
            several.clear()

    def close() -> None:
        together()
        for (db, key), e in state.items():
            out.append((1, None, db, key, *[None] * 6, e.value, e.expiry_ms, e.created_ms, e.last_access_ms, e.accesses, flushed.get(db)))

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

    for batch in batches:
        for r in batch.to_pylist():
            if r["g"] != group:
                close()
                group, state, flushed = r["g"], {}, {}
            db, key, op, now = r["db"], r["key"], r["op"], r["ts_ms"]
            if op == "":
                state[db, key] = Entry(r["arg"], r["ttl_ms"], *r["times"].values())
                continue
            r["opts"] = opts = dict(r["opts"] or ())
            if several and several[0]["seq"] != r["seq"]:
                together()
            if r["flush"] is not None and r["flush"] != flushed.get(db):
                flushed[db] = r["flush"]
                state = {k: e for k, e in state.items() if k[0] != db}
            if op == "MSETNX":
                several.append(r)
            elif op in CROSS_KEY:
                answer(r, cross(state, op, db, [(key, None), (opts["dst"], None)], now, opts))
            else:
                entry, reply = step(state.get((db, key)), op, now, r["arg"], r["num"], r["ttl_ms"], opts)
                if entry is None:
                    state.pop((db, key), None)
                else:
                    state[db, key] = entry
                answer(r, reply, opts.get("of"), int(opts["pos"]) if "pos" in opts else None)
            if len(out) > 20_000:
                yield made()
        yield made()
    close()
    yield made()


def _dealt(ks: DataFrame, log: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """Entries and commands (log also has flush) through the fold, dealt by group: the keys that commands tie together."""
    entries = ks.select("db", "key", F.lit(-(2**63)).alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.lit("").alias("op"), F.col("value").alias("arg"), F.lit(None).cast("string").alias("num"), F.col("expiry_ms").alias("ttl_ms"), F.create_map().cast("map<string,string>").alias("opts"), F.lit(None).cast("long").alias("flush"), F.struct("created_ms", "last_access_ms", "accesses").alias("times"))
    rows = log.select("db", "key", "seq", "ts_ms", "op", "arg", "num", "ttl_ms", "opts", "flush", F.lit(None).cast(_TIMES).alias("times"))
    rows = entries.unionByName(rows).withColumn("node", F.xxhash64("db", "key"))
    if comps is not None:
        rows = rows.join(comps, "node", "left").withColumn("g", F.coalesce("component", "node"))
    else:
        rows = rows.withColumn("g", F.col("node"))
    rows = rows.withColumn("pos", F.coalesce(F.col("opts")["pos"].cast("int"), F.lit(0)))
    return rows.repartition("g").sortWithinPartitions("g", "seq", "pos").drop("node", "component").mapInArrow(_walk, _OUT)


def _split(done: DataFrame) -> Outcome:
    return Outcome(done.where("kind = 1").select(*COLUMNS), done.where("kind = 0").select(*_REPLY))


def fold(ks: DataFrame, log: DataFrame) -> Outcome:
    """Any commands on single keys, each key's in the order of seq (machine.LOG_SCHEMA); the entries of ``ks`` after them, and
    the replies (REPLY_SCHEMA and dst, of, pos).

    Rows of a key are dealt to one task, sorted and read in passing: what is held is one entry, however long its history.
    Commands on one key are sequential by nature; different keys run side by side.
    """
    return _split(_dealt(ks, log.withColumn("flush", F.lit(None).cast("long"))))


def _with_flushes(log: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The log without FLUSHDB and with ``flush``, the seq of the last one before each command in its database; and (db, last)
    of the databases that have one.

    Seq is cut into STRETCHES stretches: the last FLUSHDB before each is found from one row for each stretch and database,
    which also bounds what is broadcast; inside a stretch that has one a window over its rows finds it.
    """
    flushes = log.where("op = 'FLUSHDB'")
    if not flushes.limit(1).count():
        return log.withColumn("flush", F.lit(None).cast("long")), None
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // STRETCHES + 1
    stretch = F.floor((F.col("seq") - low) / width).cast("int")
    last = flushes.groupBy("db", stretch.alias("stretch")).agg(F.max("seq").alias("own"))
    every = last.select("db").distinct().withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(STRETCHES))))
    before = Window.partitionBy("db").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    table = every.join(last, ["db", "stretch"], "left").withColumn("prior", F.last("own", True).over(before))
    rows = log.withColumn("stretch", stretch).join(F.broadcast(table), ["db", "stretch"], "left")
    inside = Window.partitionBy("db", "stretch").orderBy("seq")
    calm = rows.where("own is null").withColumn("flush", F.col("prior"))
    busy = rows.where("own is not null").withColumn("flush", F.coalesce(F.last(F.when(F.col("op") == "FLUSHDB", F.col("seq")), True).over(inside), F.col("prior")))
    out = calm.unionByName(busy).where("op <> 'FLUSHDB'").select(*log.columns, "flush")
    return out, flushes.groupBy("db").agg(F.max("seq").alias("last"))


def replay(ks: DataFrame, log: DataFrame) -> Outcome:
    """Any commands, those on several keys included; the keyspace after them, and the replies. MSETNX is a row for each of its
    keys, with equal seq; RENAME, RENAMENX and COPY have their other key in opts['dst'].

    Keys that commands tie together form a group, found by joins over hashes of keys. A group's commands are sequential by
    nature and its entries are held while they run; groups run side by side, and entries that no command names are not
    moved. FLUSHDB belongs to no group: each command knows the last one before it.
    """
    log, flushed = _with_flushes(log)
    node = lambda c: F.xxhash64("db", c)
    pairs = log.where(F.col("op").isin("RENAME", "RENAMENX", "COPY")).select(node("key").alias("a"), F.xxhash64("db", F.col("opts")["dst"]).alias("b"))
    sets = log.where("op = 'MSETNX'").select("seq", "db", node("key").alias("a"))
    sets = sets.join(sets.groupBy("seq", "db").agg(F.min("a").alias("b")), ["seq", "db"]).select("a", "b")
    comps = components(pairs.union(sets))
    names = log.select("db", "key").union(log.where(F.col("op").isin("RENAME", "RENAMENX", "COPY")).select("db", F.col("opts")["dst"])).distinct()
    done = stage(_dealt(ks.join(names, ["db", "key"], "left_semi"), log, comps), "replay")
    drop_staged(comps)
    entries, replies = done.where("kind = 1"), done.where("kind = 0").select(*_REPLY)
    rest = ks.join(names, ["db", "key"], "left_anti")
    if flushed is not None:
        entries = entries.join(F.broadcast(flushed), "db", "left").where("last is null or flushed = last")
        rest = rest.join(F.broadcast(flushed), "db", "left_anti")
    return Outcome(rest.select(*COLUMNS).union(entries.select(*COLUMNS)), replies)


def answers(replies: DataFrame) -> DataFrame:
    """One reply for each command: seq, db, reply_bytes, reply_int, reply_list, error.

    The rows of a command on several keys become one: DEL, UNLINK, EXISTS and TOUCH add up, MSET is OK once, MGET is a list
    of values in the order of its keys.
    """
    alone = replies.where("of is null").select("seq", "db", "reply_bytes", "reply_int", F.lit(None).cast("array<binary>").alias("reply_list"), "error")
    many = replies.where("of is not null").groupBy("seq", "db", "of").agg(F.sum("reply_int").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "reply_bytes"))).alias("parts"))
    listed = F.when(F.col("of") == "MGET", F.transform("parts", lambda x: x["reply_bytes"]))
    return alone.unionByName(many.select("seq", "db", F.when(F.col("of") == "MSET", F.lit(b"OK")).alias("reply_bytes"), F.when(~F.col("of").isin("MGET", "MSET"), F.col("n")).alias("reply_int"), listed.alias("reply_list"), F.lit(None).cast("string").alias("error")))


