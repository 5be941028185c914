"""The sorted fold, the barriers and the stream against a dictionary that takes one command after the other."""

import random

import pytest
from helpers import ROOT
from pyspark.sql import functions as F

from keyloom.operators.keyspace import SCHEMA, CommandError
from keyloom.operators import machine
from keyloom.plans import replay
from keyloom.plans.binder import bind, integer
from keyloom.streaming.live import command_rates, replies

OPS = ["SET", "SETNX", "GETSET", "APPEND", "SETRANGE", "INCR", "DECRBY", "INCRBYFLOAT", "DEL", "GETDEL", "EXPIRE", "PEXPIREAT", "PERSIST", "GETEX", "GET", "STRLEN", "TTL", "EXISTS", "GETRANGE"]


def random_log(n, seed, keys=6):
    rnd = random.Random(seed)
    now, out = 1_000_000, []
    for seq in range(n):
        now += rnd.randrange(1, 3000)
        op = rnd.choice(OPS)
        opts = {}
        if op == "SET" and rnd.random() < 0.5:
            opts[rnd.choice(["NX", "XX", "GET", "KEEPTTL"])] = "1"
        if op in ("EXPIRE", "PEXPIREAT") and rnd.random() < 0.5:
            opts[rnd.choice(["NX", "XX", "GT", "LT"])] = "1"
        num = {"PEXPIREAT": str(now + rnd.randrange(-2000, 9000)), "INCRBYFLOAT": "0.25"}.get(op, str(rnd.randrange(-1, 9)))
        ttl = rnd.randrange(1, 9000) if op in ("SET", "GETEX") and not opts and rnd.random() < 0.4 else None
        out.append((seq, now, rnd.randrange(2), op, f"k{rnd.randrange(keys)}", str(rnd.randrange(50)).encode(), num, ttl, opts))
    return out


def by_hand(log):
    state, answers = {}, {}
    for seq, now, db, op, key, arg, num, ttl, opts in log:
        state[db, key], answers[seq] = machine.step(state.get((db, key)), op, now, arg, num, ttl, opts)
    return {k: tuple(e) for k, e in state.items() if e is not None}, {s: tuple(r) for s, r in answers.items()}


def answers_of(df):
    return {r["seq"]: (None if r["reply_bytes"] is None else bytes(r["reply_bytes"]), r["reply_int"], r["error"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_fold_is_one_after_the_other(spark, seed):
    log = random_log(400, seed)
    done = replay.fold(spark.createDataFrame([], SCHEMA), spark.createDataFrame(log, machine.LOG_SCHEMA))
    state, answers = by_hand(log)
    got = {(r["db"], r["key"]): (bytes(r["value"]), r["expiry_ms"], r["created_ms"], r["last_access_ms"], r["accesses"]) for r in done.keyspace.collect()}
    assert got == state
    assert answers_of(done.replies) == answers


def test_fold_goes_on_from_a_keyspace(spark):
    log = random_log(200, 5)
    half = spark.createDataFrame(log[:100], machine.LOG_SCHEMA), spark.createDataFrame(log[100:], machine.LOG_SCHEMA)
    done = replay.fold(replay.fold(spark.createDataFrame([], SCHEMA), half[0]).keyspace, half[1])
    assert {(r["db"], r["key"]): bytes(r["value"]) for r in done.keyspace.collect()} == {k: e[0] for k, e in by_hand(log)[0].items()}


def test_commands_on_several_keys(spark):
    requests = [(b"SET a 1"), (b"SET b 2"), (b"RENAME a c"), (b"INCR c"), (b"COPY c d"), (b"MSETNX d 9 e 9"), (b"MSETNX f 5 g 6"), (b"SET d 7"), (b"RENAME none x"), (b"FLUSHDB"), (b"SET z 1")]
    log = [tuple(r.values()) for i, q in enumerate(requests) for r in bind(q.split()[0].decode(), q.split()[1:], i, 1000 + i)]
    done = replay.replay(spark.createDataFrame([], SCHEMA), spark.createDataFrame(log, machine.LOG_SCHEMA))
    got = answers_of(done.replies)
    assert got[2][0] == b"OK" and got[3][1] == 2 and got[4][1] == 1 and got[5][1] == 0 and got[6][1] == 1 and got[8][2] == "ERR no such key"
    assert {r["key"] for r in done.keyspace.collect()} == {"z"}


def cross_log(n, seed, keys=12, dbs=2):
    rnd = random.Random(seed)
    out = []
    for seq, row in enumerate(random_log(n, seed, keys)):
        kind = rnd.random()
        now, db, key = row[1], row[2] % dbs, row[4]
        if kind < 0.3:
            op = rnd.choice(["RENAME", "RENAMENX", "COPY"])
            opts = {"dst": f"k{rnd.randrange(keys)}"} | ({"REPLACE": "1"} if op == "COPY" and rnd.random() < 0.5 else {})
            out.append((seq, now, db, op, key, None, None, None, opts))
        elif kind < 0.4:
            out += [(seq, now, db, "MSETNX", f"k{rnd.randrange(keys)}", b"m%d" % p, None, None, {"pos": str(p)}) for p in range(3)]
        elif kind < 0.43:
            out.append((seq, now, db, "FLUSHDB", "*", None, None, None, {}))
        else:
            out.append((seq, now, db, *row[3:]))
    return out


def by_hand_across(log):
    state, answers = {}, {}
    several = {}
    for r in log:
        if r[3] == "MSETNX":
            several.setdefault(r[0], []).append((r[4], r[5]))
    for seq, now, db, op, key, arg, num, ttl, opts in log:
        if op == "FLUSHDB":
            state = {k: e for k, e in state.items() if k[0] != db}
        elif op == "MSETNX":
            if seq not in answers:
                answers[seq] = tuple(machine.cross(state, op, db, several[seq], now, {}))
        elif op in ("RENAME", "RENAMENX", "COPY"):
            answers[seq] = tuple(machine.cross(state, op, db, [(key, None), (opts["dst"], None)], now, opts))
        else:
            e, reply = machine.step(state.get((db, key)), op, now, arg, num, ttl, opts)
            answers[seq] = tuple(reply)
            state.pop((db, key), None)
            if e is not None:
                state[db, key] = e
    return {k: tuple(e) for k, e in state.items()}, answers


@pytest.mark.parametrize("seed,keys", [(1, 12), (2, 200)])
def test_replay_of_commands_on_several_keys(spark, seed, keys):
    log = cross_log(700, seed, keys)
    before = [(0, f"k{i}", b"old", 0, 1, 1, 0) for i in range(5)] + [(1, "other", b"x", 0, 1, 1, 0), (3, "far", b"y", 0, 1, 1, 0)]
    state, told = by_hand_across([(-1 - i, 0, r[0], "SET", r[1], r[2], None, None, {}) for i, r in enumerate(before)] + log)
    done = replay.replay(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(log, machine.LOG_SCHEMA))
    got = {(r["db"], r["key"]): (bytes(r["value"]), r["expiry_ms"]) for r in done.keyspace.collect()}
    assert got == {k: e[:2] for k, e in state.items()}
    assert answers_of(done.replies) == {s: a for s, a in told.items() if s >= 0}


def test_ten_thousand_renames(spark):
    rnd = random.Random(3)
    log = [(i, 1000 + i, 0, "SET" if i % 3 == 0 else "RENAME", f"k{rnd.randrange(3000)}", b"%d" % i, None, None, {} if i % 3 == 0 else {"dst": f"k{rnd.randrange(3000)}"}) for i in range(15_000)]
    state, told = by_hand_across(log)
    done = replay.replay(spark.createDataFrame([], SCHEMA), spark.createDataFrame(log, machine.LOG_SCHEMA))
    assert {(r["db"], r["key"]): bytes(r["value"]) for r in done.keyspace.collect()} == {k: e[0] for k, e in state.items()}
    assert answers_of(done.replies) == told


def test_one_answer_for_each_command(spark):
    requests = [b"MSET a 1 b 2 a 3", b"MGET b none a b", b"EXISTS a a none", b"DEL a a b", b"GET a"]
    log = [tuple(r.values()) for i, q in enumerate(requests) for r in bind(q.split()[0].decode(), q.split()[1:], i, 1000 + i)]
    done = replay.answers(replay.replay(spark.createDataFrame([], SCHEMA), spark.createDataFrame(log, machine.LOG_SCHEMA)).replies)
    got = {r["seq"]: r for r in done.collect()}
    assert len(got) == 5 == done.count() and bytes(got[0]["reply_bytes"]) == b"OK" and (got[2]["reply_int"], got[3]["reply_int"]) == (2, 2)
    assert [x and bytes(x) for x in got[1]["reply_list"]] == [b"2", None, b"3", b"2"] and got[4]["reply_bytes"] is None


def test_stream_answers_as_the_batch_does(spark, tmp_path):
    log = random_log(300, 9)
    frame = spark.createDataFrame(log, machine.LOG_SCHEMA)
    for i in range(3):  # three micro-batches, in order
        frame.where((F.col("seq") >= i * 100) & (F.col("seq") < (i + 1) * 100)).coalesce(1).write.parquet(f"{tmp_path}/log/part{i}")
    stream = spark.readStream.schema(machine.LOG_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    q = replies(stream).writeStream.format("memory").queryName("answers").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert answers_of(spark.table("answers")) == by_hand(log)[1]


def in_order(spark, tmp_path, pieces, **how):
    """The answers to a stream whose micro-batches are these pieces, and how many rows its state has at the end."""
    for i, piece in enumerate(pieces):
        spark.createDataFrame(piece, machine.LOG_SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(machine.LOG_SCHEMA).parquet(f"{tmp_path}/log")
        q = replies(stream, **how).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/replies").trigger(availableNow=True).start()
        q.awaitTermination()
    return answers_of(spark.read.schema(machine.REPLY_SCHEMA).parquet(f"{tmp_path}/replies")), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_stream_answers_commands_of_any_time_and_groups_its_keys(spark, tmp_path):
    log = random_log(300, 11, keys=40)
    times = [r[1] for r in log]
    log = [(r[0], times[(i + 200) % 300], *r[2:]) for i, r in enumerate(log)]  # the newest come first
    log = [(r[0], r[1] + (10**7 if r[0] < 100 else 0), *r[2:]) for r in log]
    got, held = in_order(spark, tmp_path, [log[:100], log[100:200], log[200:]], late=None, groups=4)
    assert got == by_hand(log)[1] and held <= 4


def test_entries_of_a_stream_go_when_they_have_expired(spark, tmp_path):
    row = lambda seq, ts, op, key, ttl=None: (seq, ts, 0, op, key, key.encode(), None, ttl, {})
    log = [[row(0, 1000, "SET", "a", 5000), row(1, 1000, "SET", "b")], [row(2, 100_000, "SET", "c")], [row(3, 200_000, "GET", "a"), row(4, 200_000, "GET", "b")]]
    got, held = in_order(spark, tmp_path, log[:2], late="1 second", groups=1000)
    assert held == 2 and len(got) == 3
    got, held = in_order(spark, tmp_path, log[2:], late="1 second", groups=1000)
    assert held == 2 and got[3][0] is None and got[4][0] == b"b"


def test_streaming_query_answers_every_command(spark, tmp_path):
    """A log whose times begin anew half way: the rows of the SQL, and none of them left out as late."""
    import duckdb
    from helpers import SF_DIR, rows

    from keyloom.plans.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.sql(f"copy (select event_id + 100 * i as event_id, ts, user_id, event_type, value, props from (select * from '{SF_DIR}/events.parquet' where event_id < 100), range(2) t(i)) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.sql(ORACLE_SQL["streaming_replay"]).df()
    got = QUERIES["streaming_replay"](spark, str(tmp_path)).toPandas()
    assert len(want) == 200 and rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_rates_of_a_stream(spark):
    log = spark.createDataFrame([(0, "SET", b"abc", 10), (0, "SET", b"d", 20), (0, "GET", None, 30)], "db int, op string, arg binary, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r["op"], r["commands"], r["bytes"]) for r in command_rates(log).collect()} == {("SET", 2, 4), ("GET", 1, 0)}


@pytest.mark.parametrize(
    "request_,text",
    [("SET a_key b_value extra", "ERR syntax error"), ("SET a", "wrong number of arguments for 'set' command"), ("UNKNOWN", "ERR unknown command `UNKNOWN` with `0` args"), ("SET a b EX 5 PX 5", "ERR syntax error"), ("SET a b NX XX", "ERR syntax error"), ("INCRBY a x", "not an integer"), ("MSET a b c", "wrong number"), ("FLUSHDB ASYNC", "ASYNC"), ("EXPIRE a 5 NX GT", "ERR syntax error")],
)
def test_refused_requests(request_, text):
    op, *args = request_.split()
    with pytest.raises(CommandError, match=text.replace("(", "\\(")):
        bind(op, [a.encode() for a in args], 0, 0)


def test_bound_requests():
    assert bind("set", [b"a", b"b", b"EX", b"5", b"NX"], 1, 0)[0]["ttl_ms"] == 5000
    assert [r["key"] for r in bind("MGET", [b"a", b"b"], 1, 0)] == ["a", "b"]
    assert integer(b"-5") == -5 and ROOT
    with pytest.raises(CommandError):
        bind("GET", [b"x" * 9000], 0, 0)
