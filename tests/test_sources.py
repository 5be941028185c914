"""Snapshots, RDB files and captures."""

import struct

import pytest

from keyloom.operators.keyspace import SCHEMA
from keyloom.sources import rdb, resp, snapshot


def ks(spark, *rows):
    return spark.createDataFrame([(db, k, v, e, 1, 1, 0) for db, k, v, e in rows], SCHEMA)


def test_snapshot_versions(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    for i in range(4):
        assert snapshot.save(ks(spark, (0, "a", str(i).encode(), 0), (1, "b", b"x", 5), (1, "c", b"y", 50)), path, as_of=10, keep=2) == i + 1
    assert snapshot.versions(spark, path) == [3, 4] and snapshot.current(spark, path) == 4
    assert {(r["db"], r["key"], bytes(r["value"])) for r in snapshot.load(spark, path).collect()} == {(0, "a", b"3"), (1, "c", b"y")}
    assert snapshot.load(spark, path, 3).where("db = 0").first()["value"] == b"2"


@pytest.mark.parametrize("kwargs,want", [({}, True), ({"now_ms": 5}, False), ({"min_keys": 10}, False), ({"min_keys": 3}, True), ({"min_data": 7, "min_keys": 99}, True), ({"enabled": False}, False)])
def test_snapshot_due(kwargs, want):
    assert snapshot.due(**{"now_ms": 100, "last_ms": 0, "interval_ms": 50, "keys_changed": 5, "data_changed": 7} | kwargs) is want


ODD = [b"", b"0", b"007", b"+5", b" 5", b"-1", b"127", b"128", b"-129", b"32768", b"2147483647", b"-2147483648", b"2147483648", b"abc", bytes(range(256)), b"x" * 70, b"y" * 20_000, "é".encode()]


def test_rdb_round_trip(spark, tmp_path):
    rows = [(i % 3, f"k{i}", v, 0 if i % 2 else 10**12 + i) for i, v in enumerate(ODD)]
    parts = {}
    for r in rdb.to_rdb(ks(spark, *rows).repartition(2, "key")).orderBy("part", "pos").collect():
        parts[r["part"]] = parts.get(r["part"], b"") + bytes(r["data"])
    for i, data in parts.items():
        (tmp_path / f"{i}.rdb").write_bytes(data)
    got = rdb.read_rdb(spark, f"file://{tmp_path}/*.rdb", as_of=5)
    assert sorted((r["db"], r["key"], bytes(r["value"]), r["expiry_ms"]) for r in got.collect()) == sorted(rows)
    assert rdb.read_rdb(spark, f"file://{tmp_path}/*.rdb", as_of=10**13).count() == len(ODD) // 2


def test_rdb_files_follow_the_size_of_the_entries(spark, tmp_path):
    from keyloom.functions.values import key_text

    keys = [b"plain", b"\xff\xfe", b"\xff\xfd", "\uefff".encode(), b"\xef\xbf\xbf", "é".encode()]
    rows = [(0, key_text(k), b"v%d" % i, 0) for i, k in enumerate(dict.fromkeys(keys))] + [(1, f"k{i}", b"x" * 1000, 0) for i in range(100)]
    n = rdb.write_rdb(ks(spark, *rows), f"file://{tmp_path}/out", file_bytes=20_000)
    assert 3 <= n <= 6 and len(list((tmp_path / "out").iterdir())) == n
    got = rdb.read_rdb(spark, f"file://{tmp_path}/out/*.rdb", as_of=5)
    assert sorted((r["db"], r["key"], bytes(r["value"]), r["expiry_ms"]) for r in got.collect()) == sorted(rows)
    assert rdb.write_rdb(ks(spark), f"file://{tmp_path}/none") == 0


def test_captures_become_a_log(spark, tmp_path):
    def wire(*lines):
        return b"".join(b"*%d\r\n" % len(x.split()) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in x.split()) for x in lines)

    (tmp_path / "a.resp").write_bytes(wire(b"SELECT 2", b"SET a 1", b"ECHO hi", b"KEYS *") + b"PING\r\n")
    (tmp_path / "b.resp").write_bytes(wire(b"MGET a b", b"SELECT 77", b"GET", b"FLUSHDB"))
    log, told = resp.read_log(spark, f"file://{tmp_path}/*.resp", 5, disabled=frozenset({"FLUSHDB"}))
    rows = sorted((r["seq"], r["db"], r["op"], r["key"]) for r in log.collect())
    assert rows == [(1, 2, "SET", "a"), (1 << 32, 0, "GET", "a"), (1 << 32, 0, "GET", "b")]
    said = {r["seq"]: (r["reply_bytes"] and bytes(r["reply_bytes"]), r["error"]) for r in told.collect()}
    assert said[0] == (b"OK", None) and said[2] == (b"hi", None) and said[4] == (b"PONG", None) and "single key" in said[3][1]
    assert [said[(1 << 32) + i][1] for i in (1, 2, 3)] == ["ERR invalid DB index", "ERR wrong number of arguments for 'get' command", "ERR command 'flushdb' is disabled"]


def test_a_snapshot_that_was_not_finished_is_no_version(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    snapshot.save(ks(spark, (0, "a", b"1", 0)), path, as_of=1)
    ks(spark, (0, "a", b"2", 0)).write.partitionBy("db").parquet(f"{path}/v=2")  # a writer that failed before its mark
    assert snapshot.current(spark, path) == 1 and snapshot.save(ks(spark, (0, "a", b"3", 0)), path, as_of=1) == 3
    assert snapshot.load(spark, path).first()["value"] == b"3"


def test_rdb_encodes_only_canonical_integers():
    assert rdb.encode_string(b"-5") == b"\xc0\xfb" and rdb.encode_string(b"300") == b"\xc1" + struct.pack("<h", 300) and rdb.encode_string(b"70000")[0] == 0xC2
    assert all(rdb.encode_string(v)[0] < 0xC0 for v in (b"007", b"+5", b" 5", b"2147483648", b"", b"5_0", b"-0"))


def test_rdb_reads_more_than_it_writes():
    packed = bytes([2]) + b"abc" + bytes([0xE0 - 0x20 | 0x00, 2])  # three plain bytes, then eight copied from three back
    packed = bytes([2]) + b"abc" + bytes([(6 << 5), 2])
    data = b"REDIS0011" + b"\xfa\x03ver\x017" + b"\xfb\x01\x00" + b"\xfe\x02" + b"\xfd" + struct.pack("<I", 4_000_000_000) + b"\x00\x01k\xc3" + bytes([len(packed), 11]) + packed + b"\xff" + bytes(8)
    assert list(rdb.decode(data)) == [(2, b"k", b"abcabcabcab", 4_000_000_000_000)]
    for bad in (b"REDIS0012\xff", b"RUDIS0009\xff", b"REDIS0009\x05", b"REDIS0009\x00\x05ab"):
        with pytest.raises(ValueError):
            list(rdb.decode(bad))


def test_requests(spark, tmp_path):
    data = b"*3\r\n$3\r\nSET\r\n$1\r\na\r\n$4\r\nb\r\nc\r\nPING\r\n*1\r\n$6\r\ndbsize\r\n*2\r\n$3\r\nGET\r\n$5\r\nab"
    assert list(resp.parse_requests(data)) == [[b"SET", b"a", b"b\r\nc"], [b"PING"], [b"dbsize"]]
    (tmp_path / "x.resp").write_bytes(data)
    assert [(r["pos"], r["op"]) for r in resp.read_requests(spark, f"file://{tmp_path}").orderBy("pos").collect()] == [(0, "SET"), (1, "PING"), (2, "DBSIZE")]
    for bad in (b"GET a\r\n", b"*1\r\n:5\r\n"):
        with pytest.raises(ValueError):
            list(resp.parse_requests(bad))


def test_replies_on_the_wire(spark):
    df = spark.createDataFrame([(b"ab", None, None), (None, 5, None), (None, None, "ERR x"), (None, None, None)], "v binary, n long, e string")
    got = [bytes(r[0]) for r in df.select(resp.reply_bytes(df.v, df.n, df.e)).collect()]
    assert got == [b"$2\r\nab\r\n", b":5\r\n", b"-ERR x\r\n", b"$-1\r\n"]
