"""RDB files of string entries: read from any store that Spark reads, and made a file for each partition."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import key_bytes, key_text

#: Marks and codes of the format, and its version.
MAGIC, VERSION = b"REDIS", 9
OP_AUX, OP_RESIZE, OP_EXPIRE_MS, OP_EXPIRE_S, OP_DB, OP_EOF, TYPE_STRING = 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xFF, 0
#: Bytes that are written at a time, and of a file.
CHUNK, FILE_BYTES = 1 << 20, 256 << 20
_RECORDS = "db int, key string, value binary, expiry_ms long"


def _size(n: int) -> bytes:
    if n < 1 << 6:
        return bytes([n])
    if n < 1 << 14:
        return bytes([0x40 | n >> 8, n & 0xFF])
    return b"\x80" + struct.pack(">I", n) if n < 1 << 32 else b"\x81" + struct.pack(">Q", n)


def encode_string(s: bytes) -> bytes:
    """A string, as an integer of 8, 16 or 32 bits if its text is exactly that integer's."""
    if 0 < len(s) <= 11:
        try:
            n = int(s)
        except ValueError:
            n = None
        if n is not None and str(n).encode() == s:
            for code, kind in ((0xC0, "b"), (0xC1, "<h"), (0xC2, "<i")):
                if -(1 << 8 * struct.calcsize(kind) - 1) <= n < 1 << 8 * struct.calcsize(kind) - 1:
                    return bytes([code]) + struct.pack(kind, n)
    return _size(len(s)) + s


def _unpack(data: bytes, size: int) -> bytes:
    """The text of an LZF block: runs of plain bytes, and copies of what has been written before."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
        else:
            n = c >> 5
            if n == 7:
                n += data[i]
                i += 1
            at = len(out) - ((c & 31) << 8) - data[i] - 1
            i += 1
            for _ in range(n + 2):
                out.append(out[at])
                at += 1
    if len(out) != size:
        raise ValueError("a compressed string has the wrong size")
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def size(self) -> tuple[int, bool]:
        """A size, or the code of a special string."""
        c = self.take(1)[0]
        if c >> 6 == 0:
            return c, False
        if c >> 6 == 1:
            return (c & 63) << 8 | self.take(1)[0], False
        if c >> 6 == 3:
            return c & 63, True
        return struct.unpack(">Q", self.take(8))[0] if c == 0x81 else struct.unpack(">I", self.take(4))[0], False

    def string(self) -> bytes:
        n, special = self.size()
        if not special:
            return self.take(n)
        if n < 3:
            return str(struct.unpack(("b", "<h", "<i")[n], self.take(1 << n))[0]).encode()
        if n == 3:
            packed, size = self.size()[0], self.size()[0]
            return _unpack(self.take(packed), size)
        raise ValueError(f"a string of unknown kind {n}")


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(db, key, value, expiry_ms) of a file's entries."""
    r = _Reader(data)
    head = r.take(9)
    if head[:5] != MAGIC or not head[5:].isdigit() or head[5:7] != b"00" or int(head[5:]) > 11:
        raise ValueError("not a file of a known version")
    db, expiry = 0, 0
    while (op := r.take(1)[0]) != OP_EOF:
        if op == OP_AUX:
            r.string(), r.string()
        elif op == OP_RESIZE:
            r.size(), r.size()
        elif op == OP_DB:
            db = r.size()[0]
        elif op == OP_EXPIRE_MS:
            expiry = struct.unpack("<Q", r.take(8))[0]
        elif op == OP_EXPIRE_S:
            expiry = struct.unpack("<I", r.take(4))[0] * 1000
        elif op == TYPE_STRING:
            yield db, r.string(), r.string(), expiry
            expiry = 0
        else:
            raise ValueError(f"an entry of unknown kind {op}")


def read_rdb(spark: SparkSession, path: str, as_of: int) -> DataFrame:
    """(db, key, value, expiry_ms) of all files in ``path``, without what has expired at ``as_of``.

    A file cannot be split, and is one value while it is read: files of more than 2 GB are refused. Keys that are not UTF-8
    keep apart, as ``key_text`` has them."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for row in decode(content.as_py()):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    return files.mapInArrow(run, _RECORDS).where((F.col("expiry_ms") == 0) | (F.col("expiry_ms") >= as_of))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    db, key, value, expiry = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(db, pa.int32()), pa.array([key_text(k) for k in key], pa.string()), pa.array(value, pa.binary()), pa.array(expiry, pa.int64())], names=["db", "key", "value", "expiry_ms"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of a whole file, a batch of entries at a time; nothing if there is no entry."""
    db, out = None, bytearray(MAGIC + b"%04d" % VERSION)
    for batch in batches:
        for r in batch.to_pylist():
            if r["db"] != db:
                db = r["db"]
                out += bytes([OP_DB]) + _size(db)
            if r["expiry_ms"]:
                out += bytes([OP_EXPIRE_MS]) + struct.pack("<Q", r["expiry_ms"])
            out += bytes([TYPE_STRING]) + encode_string(key_bytes(r["key"])) + encode_string(r["value"] or b"")
            if len(out) > CHUNK:
                yield bytes(out)
                out.clear()
    if db is not None:
        yield bytes(out) + bytes([OP_EOF]) + bytes(8)


def to_rdb(ks: DataFrame) -> DataFrame:
    """(part, pos, data): a whole RDB file for each partition in chunks of about CHUNK bytes, to be put together by pos;
    entries in the order of db and key. Repartition first for the number and size of files that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, data in enumerate(_entries(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([pos], pa.int32()), pa.array([data], pa.binary())], names=["pos", "data"])

    rows = ks.select("db", "key", "value", "expiry_ms").sortWithinPartitions("db", "key").mapInArrow(run, "pos int, data binary")
    return rows.select(F.spark_partition_id().alias("part"), "pos", "data")


def write_rdb(ks: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> int:
    """Write the entries as RDB files into the new folder ``path`` (a URI that pyarrow can write to, such as file, hdfs, s3 or
    gs), and give their number, which follows from the size of the entries: about ``file_bytes`` each.

    Tasks write one file each, piece by piece, under a name of their own, and give it its final name when it is whole; a
    task that is run again replaces that file.
    """
    total = ks.agg(F.coalesce(F.sum(F.octet_length("value").cast("long") + F.octet_length("key") + 16), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // file_bytes))
    rows = ks.select("db", "key", "value", "expiry_ms").repartition(count, F.xxhash64("db", "key")).sortWithinPartitions("db", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, folder = FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}.rdb"
        own, size = f"{folder}/.{context.taskAttemptId()}.tmp", 0
        with fs.open_output_stream(own) as out:
            for data in _entries(batches):
                out.write(data)
                size += len(data)
        if size:
            fs.move(own, name)
        else:
            fs.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([int(size > 0)], pa.int64())], names=["files"])

    return int(rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0)
