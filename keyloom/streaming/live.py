"""Commands that arrive as a stream: keyed state holds each key's entry, replies come out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.machine import LOG_SCHEMA, REPLY_SCHEMA, Entry, step

_LOG, _REPLY = ([c.split()[0] for c in schema.split(", ")] for schema in (LOG_SCHEMA, REPLY_SCHEMA))
#: The entries of a group of keys: a list for each field, so that an entry has no schema of its own in the state.
_STATE = "db array<int>, key array<string>, value array<binary>, expiry_ms array<long>, created_ms array<long>, last_access_ms array<long>, accesses array<long>"


def replies(log: DataFrame, late: str | None = "10 minutes", groups: int = 256) -> DataFrame:
    """Replies (REPLY_SCHEMA) to a stream of commands on single keys (machine.LOG_SCHEMA).

    A key's commands are applied in the order of seq within a micro-batch; micro-batches follow each other, so the source must
    deliver the log in pieces that follow each other by seq. Keys are dealt by hash to ``groups`` groups, as a call and a read
    of state cost far more than a command. A task holds one group's entries and its commands of one micro-batch, which the
    source's limits for a trigger bound. An entry goes when the key is deleted, and when the watermark, ``late`` behind the
    newest command, has passed the entry's expiry. Commands behind the watermark are left out; with ``late`` None every
    command is answered, whatever its time, and expired entries stay until a command meets them.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = {(db, k): Entry(bytes(v), *times) for db, k, v, *times in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            out = []
            for seq, now, db, op, k, arg, num, ttl_ms, opts in zip(*[rows[c].tolist() for c in _LOG], strict=True):
                entry, reply = step(entries.get((db, k)), op, now, arg, num, None if pd.isna(ttl_ms) else int(ttl_ms), dict(opts or ()))
                if entry is None:
                    entries.pop((db, k), None)
                else:
                    entries[db, k] = entry
                out.append((seq, db, k, *reply))
            done = pd.DataFrame(dict(zip(_REPLY, map(list, zip(*out, strict=True)), strict=True)))
            done["reply_int"] = done["reply_int"].astype("Int64")
            yield done
        if late is not None:
            passed = state.getCurrentWatermarkMs()
            entries = {at: e for at, e in entries.items() if not 0 < e.expiry_ms <= passed}
        if entries:
            state.update(tuple(map(list, zip(*[(*at, *e) for at, e in entries.items()], strict=True))))
            ends = [e.expiry_ms for e in entries.values() if e.expiry_ms] if late is not None else []
            if ends:
                state.setTimeoutTimestamp(min(ends) + 1)
        elif state.exists:
            state.remove()

    timed, timeout = log, GroupStateTimeout.NoTimeout
    if late is not None:
        timed, timeout = log.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    dealt = timed.withColumn("dealt", F.pmod(F.xxhash64("db", "key"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandasWithState(run, REPLY_SCHEMA, _STATE, "append", timeout)


def command_rates(log: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Commands, and bytes written, for each window of event time (column ts), database and op; rows later than ``late`` are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "db", "op").agg(F.count("*").alias("commands"), F.sum(F.coalesce(F.octet_length("arg"), F.lit(0))).alias("bytes"))
