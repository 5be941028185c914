"""Captured requests as a command log, and replies as bytes of the protocol."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyspace import CommandError
from ..operators.machine import LOG_SCHEMA
from ..plans.binder import bind, told


def parse_requests(data: bytes) -> Iterator[list[bytes]]:
    """Arguments of each request: arrays of strings, or the inline request ``PING``. A request that is cut off at the end
    is left out; bytes that begin none are an error."""
    at = 0

    def line(at: int) -> tuple[bytes, int] | None:
        end = data.find(b"\r\n", at)
        return None if end < 0 else (data[at:end], end + 2)

    while at < len(data):
        got = line(at)
        if got is None:
            return
        head, at = got
        if head.upper() == b"PING":
            yield [b"PING"]
            continue
        if head[:1] != b"*" or not head[1:].isdigit():
            raise ValueError("a request does not begin with an array")
        args = []
        for _ in range(int(head[1:])):
            got = line(at)
            if got is None:
                return
            size, at = got
            if size[:1] != b"$" or not size[1:].isdigit():
                raise ValueError("an argument is no string")
            n = int(size[1:])
            if at + n + 2 > len(data):
                return
            args.append(data[at : at + n])
            at += n + 2
        yield args


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, op, args) of the requests in captures; a task for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [r for r in parse_requests(content.as_py()) if r]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0].decode("latin-1").upper() for r in rows], pa.string()), pa.array([r[1:] for r in rows], pa.list_(pa.binary()))], names=["file", "pos", "op", "args"])

    return files.mapInArrow(run, "file string, pos long, op string, args array<binary>")


def read_log(spark: SparkSession, path: str, ts_ms: int, disabled: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """The captures in ``path`` as a command log, and the replies that need no key: (log, told).

    A capture is one connection: SELECT holds for what follows it there. Connections follow each other by their names, a
    request's seq is its connection's number and its place; all have the time ``ts_ms``. log is as machine.LOG_SCHEMA says;
    told has seq, db, reply_bytes and error, for PING, ECHO and SELECT and for requests that are refused.
    """
    names = spark.read.format("binaryFile").load(path).select("path")
    number = names.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("number"))  # names only
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(number, "path").select("number", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                db, rows = 0, []
                for pos, (name, *args) in enumerate(r for r in parse_requests(content.as_py()) if r):
                    op, seq = name.decode("latin-1").upper(), n << 32 | pos
                    try:
                        found = [r | {"reply": None, "error": None} for r in bind(op, args, seq, ts_ms, db, disabled)]
                        reply, db = told(op, args, db)
                        rows += found or [_TOLD | {"seq": seq, "db": db, "reply": reply}]
                    except CommandError as e:
                        rows.append(_TOLD | {"seq": seq, "db": db, "error": str(e)})
                    if len(rows) > 10_000:
                        yield _log_rows(rows)
                        rows = []
                yield _log_rows(rows)

    rows = files.mapInArrow(run, f"{LOG_SCHEMA}, reply binary, error string")
    log = rows.where("op is not null").select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")])
    return log, rows.where("op is null").select("seq", "db", F.col("reply").alias("reply_bytes"), "error")


_TOLD = {"seq": None, "ts_ms": None, "db": None, "op": None, "key": None, "arg": None, "num": None, "ttl_ms": None, "opts": {}, "reply": None, "error": None}


def _log_rows(rows: list[dict]) -> pa.RecordBatch:
    types = {"seq": pa.int64(), "ts_ms": pa.int64(), "db": pa.int32(), "op": pa.string(), "key": pa.string(), "arg": pa.binary(), "num": pa.string(), "ttl_ms": pa.int64(), "opts": pa.map_(pa.string(), pa.string()), "reply": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "opts" else r[c] for r in rows], t) for c, t in types.items()], names=list(types))


def write_captures(rows: DataFrame, path: str) -> int:
    """Write each row (name, data) as the file ``name``.resp in the folder ``path`` (a URI that pyarrow can write to); the
    number of files. Tasks write them under other names first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        n = 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}.tmp"
                with fs.open_output_stream(own) as out:
                    out.write(data.as_buffer())
                fs.move(own, f"{folder}/{name}.resp")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(rows.select("name", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def reply_bytes(value: Column, number: Column, error: Column, several: Column | None = None) -> Column:
    """A reply as a client reads it: an error, a number, a string, the null string, or an array of strings."""
    end = F.lit("\r\n").cast("binary")
    text = lambda c: c.cast("string").cast("binary")
    blob = lambda v: F.when(v.isNull(), F.lit(b"$-1\r\n")).otherwise(F.concat(F.lit(b"$"), text(F.octet_length(v)), end, v, end))
    if several is not None:
        head = F.concat(F.lit(b"*"), text(F.size(several)), end)
        array = F.aggregate(several, head, lambda a, v: F.concat(a, blob(v)))
        return F.when(error.isNull() & number.isNull() & value.isNull() & several.isNotNull(), array).otherwise(reply_bytes(value, number, error))
    return (
        F.when(error.isNotNull(), F.concat(F.lit(b"-"), text(error), end))
        .when(number.isNotNull(), F.concat(F.lit(b":"), text(number), end))
        .when(value.isNotNull(), F.concat(F.lit(b"$"), text(F.octet_length(value)), end, value, end))
        .otherwise(F.lit(b"$-1\r\n"))
    )
