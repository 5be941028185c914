"""Golden cases of the commands, as small batches."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import values as V
from keyloom.operators import eviction, expiry, machine, numeric, reads, scans, settings, writes
from keyloom.operators.keyspace import SCHEMA, CommandError, check_keys, keyspace, live, select_db

NOW = 1_000_000


def ks(spark, *entries):
    """Entries as key, value, expiry (0 for none)."""
    return spark.createDataFrame([(0, k, v, e, 1, 1, 0) for k, v, e in entries], SCHEMA)


def batch(spark, columns, *rows):
    return spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], f"seq long, db int, {columns}")


def one(df, column="reply_int"):
    return [r[column] if not isinstance(r[column], bytearray) else bytes(r[column]) for r in df.orderBy("seq").collect()]


def state(df):
    return {r["key"]: (bytes(r["value"]), r["expiry_ms"]) for r in df.collect()}


def test_set_get_and_conditions(spark):
    empty, some = ks(spark), ks(spark, ("a", b"b", 0))
    b = batch(spark, "key string, value binary", ("a", b"c"))
    assert one(writes.set_(empty, b, NOW, get=True).replies, "reply_bytes") == [None]
    assert one(writes.set_(some, b, NOW, get=True).replies, "reply_bytes") == [b"b"]
    assert one(writes.set_(ks(spark, ("a", b"b", NOW - 1)), b, NOW, get=True).replies, "reply_bytes") == [None]
    assert one(writes.set_(some, b, NOW, condition="NX").replies, "reply_bytes") == [None]
    assert one(writes.set_(empty, b, NOW, condition="XX").replies, "reply_bytes") == [None]
    assert state(writes.set_(ks(spark, ("a", b"b", NOW + 9)), b, NOW, keepttl=True).keyspace) == {"a": (b"c", NOW + 9)}
    assert state(writes.set_(ks(spark, ("a", b"b", NOW + 9)), b, NOW).keyspace) == {"a": (b"c", 0)}
    for name in ("ex", "px", "exat", "pxat"):
        with pytest.raises(CommandError, match="invalid expire time in 'set' command"):
            writes.set_(empty, b, NOW, **{name: 0})


def test_setnx_and_repeats(spark):
    b = batch(spark, "key string, value binary", ("a", b"1"), ("a", b"2"))
    after, replies = writes.setnx(ks(spark), b, NOW)
    assert one(replies) == [1, 0] and state(after) == {"a": (b"1", 0)}


def test_msetnx(spark):
    rows = spark.createDataFrame([(0, 0, 0, "a", b"1"), (0, 0, 1, "b", b"2"), (1, 0, 0, "x", b"3"), (1, 0, 1, "c", b"4")], "seq long, db int, pos int, key string, value binary")
    after, replies = writes.msetnx(ks(spark, ("x", b"0", 0)), rows, NOW)
    assert one(replies) == [1, 0] and set(state(after)) == {"a", "b", "x"}


def test_exists_counts_repeats_and_delete_does_not(spark):
    some = ks(spark, ("a", b"1", 0), ("old", b"1", NOW - 1))
    keys = spark.createDataFrame([(0, 0, "a"), (0, 0, "a"), (0, 0, "a"), (0, 0, "old")], "seq long, db int, key string")
    assert one(reads.exists(some, keys, NOW)) == [3]
    assert one(reads.exists(some, keys, NOW, include_expired=True)) == [4]
    after, replies = writes.delete(some, keys, NOW)
    assert one(replies) == [1] and state(after) == {}


def test_append(spark):
    b = batch(spark, "key string, value binary", ("a", b"b_value"), ("a", b"c_value"))
    after, replies = writes.append(ks(spark), b, NOW)
    assert one(replies) == [7, 14] and state(after) == {"a": (b"b_valuec_value", 0)}
    assert state(writes.append(ks(spark, ("a", b"x", NOW + 5)), b, NOW).keyspace)["a"][1] == NOW + 5


@pytest.mark.parametrize("start,end,want", [(0, 6, b"b_value"), (0, 0, b"b"), (6, 6, b"e"), (-1, -1, b"e"), (-4, -2, b"alu"), (5, 3, b""), (7, 15, b""), (3, 15, b"alue"), (-9, 2, b"")])
def test_getrange(spark, start, end, want):
    b = batch(spark, "key string, start int, end int", ("a", start, end), ("none", start, end))
    assert one(reads.getrange(ks(spark, ("a", b"b_value", 0)), b, NOW), "reply_bytes") == [want, None]


def test_getrange_takes_bytes(spark):
    b = batch(spark, "key string, start int, end int", ("a", 1, 2))
    assert one(reads.getrange(ks(spark, ("a", "xéy".encode(), 0)), b, NOW), "reply_bytes") == ["é".encode()]


def test_setrange(spark):
    b = batch(spark, "key string, offset int, value binary", ("a", 10, b"b_value"), ("a", 3, b"b_value"), ("v", 10, b"b_value"), ("a", -10, b"x"))
    after, replies = writes.setrange(ks(spark, ("v", b"value_f", NOW + 5)), b, NOW)
    assert one(replies) == [17, 17, 17, None] and one(replies, "error")[3] == "ERR offset is out of range"
    assert state(after) == {"a": (b"\0\0\0b_valueb_value", 0), "v": (b"value_f\0\0\0b_value", 0)}


def test_lcs(spark):
    pairs = [("qwertyuiop", "asdfghjkl", b""), ("b_value", "value_z", b"value"), ("a very long string", "another very string but long", b"a very string")]
    entries = [(f"{s}{i}", t.encode(), 0) for i, p in enumerate(pairs) for s, t in zip("xy", p[:2], strict=True)]
    b = batch(spark, "key string, key2 string", *[(f"x{i}", f"y{i}") for i in range(3)], ("x0", "none"))
    out = reads.lcs(ks(spark, *entries), b, NOW)
    assert one(out, "reply_bytes") == [p[2] for p in pairs] + [b""] and one(out) == [0, 5, 13, 0]
    long = V._subsequence(b"ab" * 40_000, b"b")
    assert long == b"b"


def test_incr(spark):
    cases = [(None, 1), (b"5", 6), (b"-5", -4), (str(-(2**63)).encode(), -(2**63) + 1), (b"", 1), (b"007", 8)]
    entries = [(f"k{i}", v, 0) for i, (v, _) in enumerate(cases) if v is not None]
    b = batch(spark, "key string", *[(f"k{i}",) for i in range(len(cases))])
    assert one(numeric.incr(ks(spark, *entries), b, NOW).replies) == [n for _, n in cases]
    for bad in (b"b_value", b"9223372036854775808", b"-9223372036854775809", b" 5", b"+5", b"5.0", b"-"):
        out = numeric.incr(ks(spark, ("a", bad, 0)), batch(spark, "key string", ("a",)), NOW)
        assert one(out.replies, "error") == [numeric.NOT_INTEGER] and state(out.keyspace)["a"][0] == bad
    top = numeric.incr(ks(spark, ("a", b"9223372036854775806", 0)), batch(spark, "key string", ("a",), ("a",)), NOW)
    assert one(top.replies) == [2**63 - 1, None] and one(top.replies, "error") == [None, numeric.OVERFLOW]


def test_incrbyfloat(spark):
    for steps, want in ((["1.5", "1.5"], [b"1.5", b"3"]), (["0.00001", "0.00001"], [b"0.00001", b"0.00002"]), (["5.5", "6.4"], [b"5.5", b"11.9"]), (["1", "-1"], [b"1", b"0"])):
        b = batch(spark, "key string, num string", *[("a", s) for s in steps]).withColumn("num", F.col("num").cast("decimal(28,17)"))
        assert one(numeric.incrbyfloat(ks(spark), b, NOW).replies, "reply_bytes") == want
    b = batch(spark, "key string, num string", ("a", "1")).withColumn("num", F.col("num").cast("decimal(28,17)"))
    assert one(numeric.incrbyfloat(ks(spark, ("a", b"x", 0)), b, NOW).replies, "error") == [numeric.NOT_FLOAT]


@pytest.mark.parametrize("condition,old,want", [(None, None, 0), (None, 0, 1), ("NX", 0, 1), ("NX", 9000, 0), ("XX", 0, 0), ("XX", 9000, 1), ("GT", 0, 0), ("GT", 7000, 0), ("GT", 3000, 1), ("LT", 0, 1), ("LT", 7000, 1), ("LT", 3000, 0)])
def test_expire_conditions(spark, condition, old, want):
    entries = [] if old is None else [("a", b"v", old and NOW + old)]
    for f, amount in ((expiry.expire, 5), (expiry.pexpire, 5000), (expiry.pexpireat, NOW + 5000), (expiry.expireat, NOW // 1000 + 5)):
        assert one(f(ks(spark, *entries), batch(spark, "key string, amount long", ("a", amount)), NOW, condition).replies) == [want]


def test_expire_of_nothing_deletes(spark):
    out = expiry.expire(ks(spark, ("a", b"v", 0)), batch(spark, "key string, amount long", ("a", 0)), NOW)
    assert one(out.replies) == [1] and state(out.keyspace) == {}


def test_ttl_and_persist(spark):
    some = ks(spark, ("a", b"v", NOW + 1500), ("b", b"v", 0), ("gone", b"v", NOW - 1))
    b = batch(spark, "key string", ("a",), ("b",), ("gone",), ("none",))
    assert one(expiry.ttl(some, b, NOW)) == [2, -1, -2, -2]
    assert one(expiry.pttl(some, b, NOW)) == [1500, -1, -2, -2]
    assert one(expiry.expiretime(some, b, NOW)) == [(NOW + 1500) // 1000, -1, -2, -2]
    assert one(expiry.pexpiretime(some, b, NOW)) == [NOW + 1500, -1, -2, -2]
    out = expiry.persist(some, b, NOW)
    assert one(out.replies) == [1, 0, 0, 0] and state(out.keyspace)["a"][1] == 0


def test_enforced_ttl(spark):
    some = ks(spark, ("a", b"", 0), ("b", b"", NOW + 8 * 86_400_000), ("c", b"", NOW + 5))
    out = some.select("key", writes.enforce_ttl(F.col("expiry_ms"), NOW, 86_400_000, 7 * 86_400_000).alias("e"))
    assert {r["key"]: r["e"] - NOW for r in out.collect()} == {"a": 86_400_000, "b": 7 * 86_400_000, "c": 5}


def test_copy_and_rename(spark):
    some = ks(spark, ("a", b"1", NOW + 5), ("b", b"2", 0))
    b = lambda *p: batch(spark, "key string, dst string", *p)
    assert one(writes.copy(some, b(("none", "c")), NOW).replies) == [0]
    assert one(writes.copy(some, b(("a", "b")), NOW).replies) == [0]
    out = writes.copy(some, b(("a", "b")), NOW, replace=True)
    assert one(out.replies) == [1] and state(out.keyspace)["b"] == (b"1", 0)
    out = writes.rename(some, b(("a", "b")), NOW)
    assert state(out.keyspace) == {"b": (b"1", NOW + 5)}
    assert one(writes.rename(some, b(("none", "c")), NOW).replies, "error") == ["ERR no such key"]
    assert one(writes.rename(some, b(("none", "none")), NOW).replies, "reply_bytes") == [b"OK"]
    assert one(writes.renamenx(some, b(("a", "b")), NOW).replies) == [0]
    assert one(writes.renamenx(some, b(("a", "a")), NOW).replies) == [0]


def test_getdel_getex(spark):
    some = ks(spark, ("a", b"1", NOW + 5))
    b = batch(spark, "key string", ("a",), ("a",), ("none",))
    out = writes.getdel(some, b, NOW)
    assert one(out.replies, "reply_bytes") == [b"1", None, None] and state(out.keyspace) == {}
    assert state(writes.getex(some, b, NOW, persist=True).keyspace) == {"a": (b"1", 0)}
    bad = writes.getex(some, b, NOW, ex=0)
    assert one(bad.replies, "error")[0].startswith("ERR invalid expire") and one(bad.replies, "error")[2] is None


@pytest.mark.parametrize("pattern,want", [("a_*", 1), ("*key", 4), ("a_???", 1), ("a\\_key", 1), ("[a-z]_key", 4), ("*", 5), ("nomatch", 0), ("[^a]_key", 3), ("?", 0), ("[a-", 0), ("", 0), ("[-a]_key", 1), ("[a-b-c]_key", 3), ("key_zzz", 1)])
def test_keys(spark, pattern, want):
    some = ks(spark, *[(k, b"", 0) for k in ("a_key", "b_key", "c_key", "d_key", "key_zzz")])
    assert scans.keys(some, 0, pattern, NOW).count() == want


def test_glob_counts_bytes(spark):
    some = ks(spark, ("é", b"", 0), ("x", b"", 0))
    assert {r[0] for r in scans.keys(some, 0, "?", NOW).collect()} == {"x"}
    assert {r[0] for r in scans.keys(some, 0, "??", NOW).collect()} == {"é"}
    assert scans.keys(some, 0, "?", NOW, compat=True).count() == 2


def test_scan_pages_between_bounds_have_no_cap(spark):
    from helpers import SF_DIR

    from keyloom.plans.queries import QUERIES

    plan = QUERIES["scan_pages_union"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
    some = spark.createDataFrame([(0, f"k{i}") for i in range(300)] + [(0, ""), (1, "k1")], "db int, key string")
    some = keyspace(some, F.col("db"), F.col("key"), F.lit(b"v"))
    h = some.where("db = 0").select(F.xxhash64("key").alias("h"), "key").orderBy("h").collect()
    cuts = [None, (h[20]["h"], h[20]["key"]), (h[21]["h"], ""), (0, ""), (h[250]["h"], h[250]["key"]), None]
    pages = [[r["key"] for r in scans.scan(some, 0, a, NOW, count=None, until=b).collect()] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert len(pages[0]) == 21 and len(pages[1]) == 0 and sorted(k for p in pages for k in p) == sorted(r["key"] for r in h)
    assert [r["key"] for r in scans.scan(some, 0, None, NOW, count=30, until=cuts[1]).collect()] == [r["key"] for r in h[:21]]


def test_all_scan_pages_are_those_of_a_client(spark):
    keys = [f"k{i}" for i in range(230)] + ["", "é", None]
    some = keyspace(spark.createDataFrame([(0, k) for k in keys] + [(1, "k1")], "db int, key string"), F.col("db"), F.col("key"), F.lit(b"v"))
    want, cursor = [], None
    while page := scans.scan(some, 0, cursor, NOW, match="k*[02468]", count=20).collect():
        cursor = (page[-1]["hash"], page[-1]["key"])
        want.append((cursor, [r["key"] for r in page if r["matches"]]))
    got = scans.scan_pages(some, 0, NOW, match="k*[02468]", count=20).orderBy("page").collect()
    assert [r["page"] for r in got] == list(range(12)) and [(tuple(r["cursor"]), r["keys"]) for r in got] == want
    assert scans.scan_pages(some.limit(0), 0, NOW).count() == 0


def test_plan_of_a_scan_does_not_grow_with_its_pages(spark, tmp_path):
    from keyloom.plans.queries import QUERIES

    spark.range(2600).select(F.concat(F.lit("http://a/"), "id").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    done = QUERIES["scan_match_pages"](spark, str(tmp_path))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Union" not in plan
    assert done.count() == done.distinct().count() == 1300


def test_scan_pages_cover_each_key_once(spark):
    some = ks(spark, *[(f"k{i}", b"", 0) for i in range(25)])
    pages = list(scans.scan_all(some, 0, NOW, count=4))
    assert len(pages) == 7 and sorted(k for p in pages for k in p) == sorted(f"k{i}" for i in range(25))
    assert sum(len(p) for p in scans.scan_all(some, 0, NOW, match="k1*", count=4)) == 11
    with pytest.raises(CommandError):
        scans.scan(some, 0, None, NOW, type_="string")


def test_eviction(spark):
    some = spark.createDataFrame([(0, f"k{i}", b"v", i % 3 and NOW + i, i, 100 - i, i * 7 % 10) for i in range(20)], SCHEMA)
    assert [r["key"] for r in eviction.victims(some, "lru", 3).collect()] == ["k19", "k18", "k17"]
    assert [r["key"] for r in eviction.victims(some, "ttl", 2).collect()] == ["k1", "k2"]
    assert eviction.evict_to(some, "lfu", 15).count() == 15
    assert eviction.victims(some, "random", 5, only_ttl=True, sample=8, seed=1).count() == 5
    assert eviction.pressure(15, 10, 20) == 0.5 and eviction.pressure(5, 10, 20) == 0


def test_limits_and_settings(spark):
    assert select_db(15) == 15
    for n in (16, -1):
        with pytest.raises(CommandError, match="invalid DB index"):
            select_db(n)
    checked = check_keys(batch(spark, "key string", ("",), ("x" * 9000,), ("a",)))
    assert [e is None for e in one(checked, "error")] == [False, False, True]
    assert settings.seconds("5m") == 300 and settings.size("64mb") == 64 << 20 and settings.size("80%", 50) == 40
    got = settings.config_get(spark, settings.Settings(), "databases", "none")
    assert [tuple(r) for r in got.collect()] == [("databases", "16")]
    assert live(ks(spark, ("a", b"", NOW)), NOW).count() == 1


def in_turn(entries, commands):
    """Commands (op, key, arg, num, ttl, opts) on entries one after the other, as the machine does them."""
    state = {(0, k): machine.Entry(v, e, 1, 1, 0) for k, v, e in entries}
    told = []
    for op, key, arg, num, ttl, opts in commands:
        if op in ("RENAME", "RENAMENX", "COPY"):
            told.append(machine.cross(state, op, 0, [(key, None), (opts["dst"], None)], NOW, opts))
            continue
        e, reply = machine.step(state.get((0, key)), op, NOW, arg, num, ttl, opts)
        state.pop((0, key), None)
        if e is not None:
            state[0, key] = e
        told.append(reply)
    return {k[1]: (e.value, e.expiry_ms) for k, e in state.items()}, told


def same(outcome, entries, commands, *columns):
    want, told = in_turn(entries, commands)
    got = state(outcome.keyspace)
    alive = lambda s: {k: v for k, v in s.items() if not v[1] or v[1] >= NOW}
    assert alive(got) == alive(want)
    replies = {r["seq"]: r for r in outcome.replies.collect()}
    for seq, reply in enumerate(told):
        for c in columns:
            value = replies[seq][c]
            assert (bytes(value) if isinstance(value, bytearray) else value) == getattr(reply, c), (seq, c, commands[seq])


def crowd(rnd, n=40, keys=7):
    return [(f"k{i}", rnd.choice([b"5", b"x", b"", b"9223372036854775800", b"-9223372036854775800"]), rnd.choice([0, 0, NOW + rnd.randrange(1, 9000), NOW - 5])) for i in range(keys - 2)], [f"k{rnd.randrange(keys)}" for _ in range(n)]


@pytest.mark.parametrize("condition", [None, "NX", "XX", "GT", "LT"])
def test_expiry_of_recurring_keys(spark, condition):
    rnd = random.Random(hash(condition) % 7)
    for f, op, unit in ((expiry.expire, "EXPIRE", 1), (expiry.pexpireat, "PEXPIREAT", 0)):
        entries, keys = crowd(rnd, 60, 12)
        amounts = [rnd.choice([0, -1, *range(1, 9)]) if unit else rnd.choice([0, NOW - 3, *range(NOW, NOW + 9000, 900)]) for _ in keys]
        b = batch(spark, "key string, amount long", *zip(keys, amounts, strict=True))
        same(f(ks(spark, *entries), b, NOW, condition), entries, [(op, k, None, str(a), None, {condition: "1"} if condition else {}) for k, a in zip(keys, amounts, strict=True)], "reply_int")


def test_counters_go_on_after_an_overflow(spark):
    rnd = random.Random(1)
    entries, keys = crowd(rnd, 60, 9)
    steps = [rnd.choice([1, -5, 9, 2**62, -(2**62), 2**63 - 1, -(2**63)]) for _ in keys]
    b = batch(spark, "key string, num long", *zip(keys, steps, strict=True))
    same(numeric.incrby(ks(spark, *entries), b, NOW), entries, [("INCRBY", k, None, str(n), None, {}) for k, n in zip(keys, steps, strict=True)], "reply_int", "error")
    same(numeric.decrby(ks(spark, *entries), b, NOW), entries, [("DECRBY", k, None, str(n), None, {}) for k, n in zip(keys, steps, strict=True)], "reply_int", "error")


@pytest.mark.parametrize("op,extra", [("RENAME", {}), ("RENAMENX", {}), ("COPY", {}), ("COPY", {"REPLACE": "1"})])
def test_moves_between_recurring_keys(spark, op, extra):
    rnd = random.Random(2)
    entries, keys = crowd(rnd, 24, 16)
    to = [f"k{rnd.randrange(16)}" for _ in keys] + ["lone"]
    keys = keys + ["k0"]
    b = batch(spark, "key string, dst string", *zip(keys, to, strict=True))
    f = {"RENAME": writes.rename, "RENAMENX": writes.renamenx, "COPY": lambda *a: writes.copy(*a, replace=bool(extra))}[op]
    same(f(ks(spark, *entries), b, NOW), entries, [(op, k, None, None, None, {"dst": d, **extra}) for k, d in zip(keys, to, strict=True)], "reply_bytes" if op == "RENAME" else "reply_int", *(["error"] if op != "COPY" else []))
    assert state(writes.rename(ks(spark, ("a", b"1", 0)), batch(spark, "key string, dst string", ("a", "b"), ("b", "c")), NOW).keyspace) == {"c": (b"1", 0)}


def test_msetnx_of_shared_keys(spark):
    rows = spark.createDataFrame([(0, 0, 0, "a", b"1"), (1, 0, 0, "a", b"2"), (1, 0, 1, "b", b"2"), (2, 0, 0, "c", b"3"), (3, 0, 0, "b", b"4"), (3, 0, 1, "b", b"5")], "seq long, db int, pos int, key string, value binary")
    after, replies = writes.msetnx(ks(spark), rows, NOW)
    assert one(replies) == [1, 0, 1, 1] and {k: v for k, (v, _) in state(after).items()} == {"a": b"1", "b": b"5", "c": b"3"}


def test_mset_takes_the_last_of_very_many(spark):
    rows = spark.createDataFrame([(1, 0, 1_000_001, "a", b"early"), (2, 0, 0, "a", b"late"), (2, 0, 1, "b", b"1"), (2, 0, 2, "b", b"2")], "seq long, db int, pos int, key string, value binary")
    assert {k: v for k, (v, _) in state(writes.mset(ks(spark), rows, NOW).keyspace).items()} == {"a": b"late", "b": b"2"}


@pytest.mark.parametrize("op,kwargs,opts", [("SET", {"condition": "NX"}, {"NX": "1"}), ("SET", {"condition": "XX", "keepttl": True}, {"XX": "1", "KEEPTTL": "1"}), ("SET", {"get": True}, {"GET": "1"}), ("SET", {"condition": "NX", "pxat": 5}, {"NX": "1", "PXAT": "5"}), ("SET", {"condition": "XX", "pxat": 5}, {"XX": "1", "PXAT": "5"}), ("SET", {"get": True, "pxat": 5}, {"GET": "1", "PXAT": "5"}), ("GETEX", {"pxat": 5}, {"PXAT": "5"}), ("GETEX", {"persist": True}, {"PERSIST": "1"}), ("GETDEL", {}, {}), ("APPEND", {}, {}), ("PERSIST", {}, {})])
def test_other_writes_of_recurring_keys(spark, op, kwargs, opts):
    entries, keys = crowd(random.Random(5), 30, 9)
    b = batch(spark, "key string, value binary", *[(k, b"v%d" % i) for i, k in enumerate(keys)])
    f = {"SET": writes.set_, "GETEX": writes.getex, "GETDEL": writes.getdel, "APPEND": writes.append, "PERSIST": expiry.persist}[op]
    same(f(ks(spark, *entries), b, NOW, **kwargs), entries, [(op, k, b"v%d" % i, None, None, opts) for i, k in enumerate(keys)], "reply_int" if op in ("APPEND", "PERSIST") else "reply_bytes")


def test_a_small_batch_does_not_shuffle_the_keyspace(spark, tmp_path):
    ks(spark, *[(f"k{i}", b"v", 0) for i in range(1000)]).write.parquet(f"{tmp_path}/ks")
    stored = spark.read.parquet(f"{tmp_path}/ks")
    batch(spark, "key string, value binary", ("k1", b"x"), ("new", b"y")).write.parquet(f"{tmp_path}/batch")
    for condition in ("NX", "XX"):
        plan = writes.set_(stored, spark.read.parquet(f"{tmp_path}/batch"), NOW, condition=condition).keyspace
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" in text
