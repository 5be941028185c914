"""One key's commands, one after the other: what a fold over a sorted log and a stream's state apply to each row."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from typing import NamedTuple

LOG_SCHEMA = "seq long, ts_ms long, db int, op string, key string, arg binary, num string, ttl_ms long, opts map<string,string>"
REPLY_SCHEMA = "seq long, db int, key string, reply_bytes binary, reply_int long, error string"


class Entry(NamedTuple):
    """A key's value and times; ``expiry_ms`` 0 for none."""

    value: bytes
    expiry_ms: int = 0
    created_ms: int = 0
    last_access_ms: int = 0
    accesses: int = 0


class Reply(NamedTuple):
    """Bytes, a number or an error; all null for the null reply."""

    reply_bytes: bytes | None = None
    reply_int: int | None = None
    error: str | None = None


OK, NULL = Reply(b"OK"), Reply()
_INT_ERROR = Reply(error="ERR value is not an integer or out of range")


def _int(value: bytes) -> int | None:
    text = value.decode("latin-1")
    digits = text[1:] if text.startswith("-") else text
    if not text:
        return 0
    if not digits or len(digits) > 19 or any(c not in "0123456789" for c in digits):
        return None
    n = int(text)
    return n if -(2**63) <= n < 2**63 else None


def decimal_text(n: Decimal) -> str:
    """As a number is stored: 17 decimals at most, no trailing zeros, no minus before zero."""
    text = f"{n.quantize(Decimal(1).scaleb(-17)):f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def _expiry(op: str, now: int, ttl_ms: int | None, opts: dict[str, str]) -> int | Reply:
    """The absolute expiry that a command asks for, 0 for none; a ttl_ms is relative, PXAT and EXAT are not."""
    for name, unit in (("PXAT", 1), ("EXAT", 1000)):
        if name in opts:
            amount = int(opts[name]) * unit
            return amount if amount > 0 else Reply(error=f"ERR invalid expire time in '{op.lower()}' command")
    if ttl_ms is not None:
        return now + ttl_ms if ttl_ms > 0 else Reply(error=f"ERR invalid expire time in '{op.lower()}' command")
    return 0


def slice_bytes(value: bytes, start: int, end: int) -> bytes:
    """Bytes start to end, both included, negative ones from the end."""
    n = len(value)
    a, b = start + n if start < 0 else start, end + n if end < 0 else end
    return b"" if a < 0 or b < a or a >= n else value[a : b + 1]


def cross(state: dict[tuple[int, str], Entry], op: str, db: int, args: list[tuple[str, bytes | None]], now: int, opts: dict[str, str]) -> Reply:
    """A command on several keys of ``db`` applied to ``state``, and its reply: RENAME, RENAMENX and COPY of the first key to
    the second, MSETNX of all keys and values."""
    live = lambda key: (e := state.get((db, key))) is not None and not (e.expiry_ms and now > e.expiry_ms)
    if op == "MSETNX":
        if any(live(key) for key, _ in args):
            return Reply(reply_int=0)
        for key, value in args:
            state[db, key] = Entry(value or b"", 0, now, now, 0)
        return Reply(reply_int=1)
    (src, _), (dst, _) = args
    if op == "COPY":
        if not live(src) or live(dst) and "REPLACE" not in opts:
            return Reply(reply_int=0)
        state[db, dst] = Entry(state[db, src].value, 0, now, now, 0)
        return Reply(reply_int=1)
    if src == dst:
        return Reply(reply_int=0) if op == "RENAMENX" else OK
    if not live(src):
        return Reply(error="ERR no such key")
    if op == "RENAMENX" and live(dst):
        return Reply(reply_int=0)
    state[db, dst] = state.pop((db, src))
    return Reply(reply_int=1) if op == "RENAMENX" else OK


def step(e: Entry | None, op: str, now: int, arg: bytes | None, num: str | None, ttl_ms: int | None, opts: dict[str, str] | None) -> tuple[Entry | None, Reply]:
    """The entry and the reply after one command at ``now``; an expired entry is none."""
    opts = opts or {}
    if e is not None and e.expiry_ms and now > e.expiry_ms:
        e = None
    arg = arg or b""
    write = lambda v, at: Entry(v, at, now, now, 0)

    if op in ("SET", "SETNX", "SETEX", "PSETEX", "GETSET", "MSET"):
        nx, xx = op == "SETNX" or "NX" in opts, "XX" in opts
        at = _expiry(op, now, ttl_ms, opts)
        if isinstance(at, Reply):
            return e, at
        if op in ("SETEX", "PSETEX") and not at:
            return e, Reply(error=f"ERR invalid expire time in '{op.lower()}' command")
        if "KEEPTTL" in opts and e is not None:
            at = e.expiry_ms
        blocked = nx and e is not None or xx and e is None
        before = Reply(e.value) if e is not None else NULL
        after = e if blocked else write(arg, at)
        if op == "SETNX":
            return after, Reply(reply_int=int(not blocked))
        return after, before if op == "GETSET" or "GET" in opts else NULL if blocked else OK
    if op == "APPEND":
        v = (e.value if e else b"") + arg
        return write(v, e.expiry_ms if e else 0), Reply(reply_int=len(v))
    if op == "SETRANGE":
        at = int(num or 0)
        if at < 0:
            return e, Reply(error="ERR offset is out of range")
        v = e.value if e else b""
        if arg:
            v = v.ljust(at, b"\0")
            v = v[:at] + arg + v[at + len(arg) :]
        return write(v, 0), Reply(reply_int=len(v))
    if op in ("INCR", "DECR", "INCRBY", "DECRBY"):
        by = 1 if op in ("INCR", "DECR") else int(num or 0)
        old = 0 if e is None else _int(e.value)
        if old is None:
            return e, _INT_ERROR
        new = old + (by if op.startswith("INCR") else -by)
        if not -(2**63) <= new < 2**63:
            return e, Reply(error="ERR increment or decrement would overflow")
        return write(str(new).encode(), e.expiry_ms if e else 0), Reply(reply_int=new)
    if op == "INCRBYFLOAT":
        try:
            text = decimal_text((Decimal(e.value.decode("latin-1") or "0") if e else Decimal(0)) + Decimal(num or "0"))
        except (InvalidOperation, ValueError):
            return e, Reply(error="ERR value is not a valid float")
        return write(text.encode(), e.expiry_ms if e else 0), Reply(text.encode())
    if op in ("DEL", "UNLINK"):
        return None, Reply(reply_int=int(e is not None))
    if op == "GETDEL":
        return None, Reply(e.value) if e else NULL
    if op in ("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"):
        amount = int(num or 0)
        if e is None:
            return None, Reply(reply_int=0)
        if amount <= 0:
            return None, Reply(reply_int=1)
        new = amount * (1 if op.startswith("P") else 1000) + (0 if op.endswith("AT") else now)
        old = e.expiry_ms
        ok = not ("NX" in opts and old or "XX" in opts and not old or "GT" in opts and not (old and new > old) or "LT" in opts and not (not old or new < old))
        return (e._replace(expiry_ms=new), Reply(reply_int=1)) if ok else (e, Reply(reply_int=0))
    if op == "PERSIST":
        had = e is not None and e.expiry_ms != 0
        return e._replace(expiry_ms=0) if had else e, Reply(reply_int=int(had))
    if op == "GETEX":
        if e is None:
            return None, NULL
        at = _expiry(op, now, ttl_ms, opts)
        if isinstance(at, Reply):
            return e, at
        return e._replace(expiry_ms=at if at else 0 if "PERSIST" in opts else e.expiry_ms), Reply(e.value)
    if e is not None:
        e = e._replace(last_access_ms=now, accesses=e.accesses + 1)
    if op == "GET":
        return e, Reply(e.value) if e else NULL
    if op in ("GETRANGE", "SUBSTR"):
        return e, Reply(slice_bytes(e.value, int(opts.get("start", 0)), int(opts.get("end", -1)))) if e else NULL
    if op == "STRLEN":
        return e, Reply(reply_int=len(e.value) if e else 0)
    if op in ("EXISTS", "TOUCH"):
        return e, Reply(reply_int=int(e is not None))
    if op in ("TTL", "PTTL", "EXPIRETIME", "PEXPIRETIME"):
        if e is None or not e.expiry_ms:
            return e, Reply(reply_int=-2 if e is None else -1)
        left = e.expiry_ms if op.endswith("TIME") else e.expiry_ms - now
        return e, Reply(reply_int=left if op.startswith("P") else left // 1000 if op.endswith("TIME") else -(-left // 1000))
    return e, Reply(error=f"ERR unknown command `{op}` with `0` args")
