"""Expressions on byte-string values: slices, overlays, numbers kept as text, globs, common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text column."""
    return F.encode(text, "utf-8")


def byte_slice(value: Column, start: Column | int, end: Column | int) -> Column:
    """Bytes start to end of a value, both included; negative places count from its end.

    A start that lies before the value or after it, or after the end, gives an empty slice; a null value stays null.
    """
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    size = F.octet_length(value)
    a = F.when(start < 0, start + size).otherwise(start)
    b = F.least(F.when(end < 0, end + size).otherwise(end), size - 1)
    hollow = (a < 0) | (b < a) | (a >= size)
    return F.when(value.isNull(), None).when(hollow, F.unhex(F.lit(""))).otherwise(F.substring(value, (a + 1).cast("int"), (b - a + 1).cast("int")))


def overlay_bytes(value: Column, offset: Column | int, patch: Column) -> Column:
    """The value with ``patch`` written over it from byte ``offset`` on; a gap is filled with zero bytes. A null value is
    empty; an empty patch changes nothing."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    old = F.coalesce(value, F.unhex(F.lit("")))
    size, n = F.octet_length(old), F.octet_length(patch)
    gap = F.greatest(offset - size, F.lit(0))
    head = F.concat(F.substring(old, F.lit(1), F.least(offset, size).cast("int")), F.unhex(F.repeat(F.lit("00"), gap.cast("int"))))
    tail = F.when(size > offset + n, F.substring(old, (offset + n + 1).cast("int"), (size - offset - n).cast("int"))).otherwise(F.unhex(F.lit("")))
    return F.when(n == 0, old).otherwise(F.concat(head, patch, tail))


def parse_int(value: Column) -> Column:
    """The number that a stored text stands for: digits, perhaps after a minus, within 64 bits; an empty one is 0.

    Null for anything else, also for a sign alone, a plus, blanks or a fraction.
    """
    text = value.cast("string")
    return F.when(text == "", F.lit(0).cast("long")).when(text.rlike("^-?[0-9]{1,19}$"), text.try_cast("long"))


def parse_decimal(value: Column) -> Column:
    """A stored decimal number; an empty text is 0, anything that is no number null."""
    text = value.cast("string")
    return F.when(text == "", F.lit(0).cast("decimal(30,17)")).when(text.rlike("^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("decimal(30,17)"))


def decimal_text(number: Column) -> Column:
    """A decimal number as it is stored: without trailing zeros, whole numbers without a point."""
    text = number.cast("decimal(38,17)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.when(plain.isin("-0", "0E-17", "0"), "0").otherwise(plain)


def glob_regex(pattern: str, compat: bool = False) -> str | None:
    """A regular expression (for ``rlike`` on ISO-8859-1 text, so that a byte is a character) for a glob; None matches nothing.

    ``*`` is any run of bytes, ``?`` one byte, ``[a-z]`` a class, ``[^a-z]`` its complement, and a backslash makes the next
    byte plain. A class that is not closed matches nothing; a leading ``-`` in a class is plain. In ``[a-c-e]`` the end of a
    range begins the next. With ``compat`` the pattern ``?`` alone matches every key.
    """
    if not pattern:
        return None
    if compat and pattern == "?":
        return "(?s)^.+$"
    plain = lambda c: c if c.isalnum() or c == "_" else "\\x{%x}" % ord(c)
    data = pattern.encode().decode("latin-1")
    out, i = "", 0
    while i < len(data):
        c = data[i]
        if c == "*":
            while i + 1 < len(data) and data[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(data):
            i += 1
            out += plain(data[i])
        elif c == "[":
            i += 1
            negate = i < len(data) and data[i] == "^"
            i += negate
            parts, last, open_ = [], None, True
            while i < len(data) and open_:
                c = data[i]
                if c == "]":
                    open_ = False
                elif c == "\\" and i + 1 < len(data):
                    i += 1
                    last = data[i]
                    parts.append(plain(last))
                elif c == "-" and last is not None and i + 1 < len(data) and data[i + 1] != "]":
                    i += 1
                    a, b = sorted((last, data[i]))
                    parts.append(f"{plain(a)}-{plain(b)}")
                    last = data[i]
                else:
                    last = c
                    parts.append(plain(c))
                i += open_
            if open_:
                return None
            out += f"[{'^' if negate else ''}{''.join(parts)}]" if parts else "." if negate else "(?!)"
        else:
            out += plain(c)
        i += 1
    return f"(?s)^(?=.){out}$"


def glob_prefix(pattern: str) -> str:
    """The plain text with which every match of a glob begins; it prunes files by their smallest and largest keys."""
    out = ""
    for c in pattern:
        if c in "*?[\\" or ord(c) > 126:
            break
        out += c
    return out


def glob_match(key: Column, pattern: str, compat: bool = False) -> Column:
    """Whether a key matches a glob; an empty key or pattern never does."""
    rule = glob_regex(pattern, compat)
    if rule is None:
        return F.lit(False)
    prefix = glob_prefix(pattern)
    if prefix == pattern:
        return key == pattern
    simple = prefix and pattern == prefix + "*"
    test = (F.length(key) > 0) if simple else F.decode(F.encode(key, "utf-8"), "iso-8859-1").rlike(rule)
    return key.startswith(prefix) & test if prefix else test


#: A row of the table of common subsequences is kept for each so many bytes of the first string; those between are made again.
KEPT_ROWS = 256


def _rows(v: int, part: bytes, masks: dict[int, int], whole: int) -> Iterator[int]:
    """Rows of the table after each byte of ``part``, from row ``v`` on: bit j is 0 where the row's length rises at byte j of
    the second string, so that a row of any width is a few operations on one number."""
    for c in part:
        hit = v & masks.get(c, 0)
        v = ((v + hit) | (v - hit)) & whole
        yield v


def _masks(b: bytes) -> dict[int, int]:
    """Of each byte: the places where it stands in ``b``, as bits."""
    out = {}
    for c in set(b):
        out[c] = int.from_bytes(np.packbits(np.frombuffer(b, np.uint8) == c, bitorder="little").tobytes(), "little")
    return out


def subsequence_length(a: bytes | None, b: bytes | None) -> int:
    """Length of the longest common subsequence of two byte strings."""
    if not a or not b:
        return 0
    whole = v = (1 << len(b)) - 1
    for v in _rows(v, a, _masks(b), whole):
        pass
    return len(b) - v.bit_count()


def _subsequence(a: bytes | None, b: bytes | None) -> bytes:
    """The longest common subsequence of two byte strings, read from the end of the table: of two ways the one that leaves
    the first string's byte is taken only if it is strictly longer. Memory grows with the second string's length."""
    if not a or not b:
        return b""
    masks, whole = _masks(b), (1 << len(b)) - 1
    kept, v = [whole], whole
    for at in range(0, len(a), KEPT_ROWS):
        for v in _rows(v, a[at : at + KEPT_ROWS], masks, whole):
            pass
        kept.append(v)
    out, i, j, base = bytearray(), len(a), len(b), len(a) + 1
    rows: list[int] = []
    length = lambda v, j: j - (v & ((1 << j) - 1)).bit_count()
    while i and j:
        if i - 1 < base:  # rows base to i are needed
            n = (i - 1) // KEPT_ROWS
            base = n * KEPT_ROWS
            rows = [kept[n], *_rows(kept[n], a[base : base + KEPT_ROWS], masks, whole)]
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif length(rows[i - 1 - base], j) > length(rows[i - base], j - 1):
            i -= 1
        else:
            j -= 1
    return bytes(reversed(out))


def common_subsequence(a: Column, b: Column) -> Column:
    """The longest common subsequence of two values, empty if either is null."""

    @F.pandas_udf("binary")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_subsequence(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return lcs(a.cast("binary"), b.cast("binary"))


def common_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two values, 0 if either is null."""

    @F.pandas_udf("long")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([subsequence_length(p, q) for p, q in zip(x, y, strict=True)], dtype="int64")

    return lcs(a.cast("binary"), b.cast("binary"))


#: Bytes that are not UTF-8 are kept in text keys as these characters, as is every byte of one of these characters.
_RAW = 0xEF00


def key_text(key: bytes) -> str:
    """A key as text, and different keys as different texts: bytes that are not UTF-8 stand as private characters."""
    try:
        text = key.decode()
        if not any(_RAW + 0x80 <= ord(c) <= _RAW + 0xFF for c in text):
            return text
    except UnicodeDecodeError:
        text = key.decode("utf-8", "surrogateescape")
    plain = lambda c: "".join(chr(_RAW + x) for x in c.encode()) if _RAW + 0x80 <= ord(c) <= _RAW + 0xFF else chr(_RAW + ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c
    return "".join(map(plain, text))


def key_bytes(text: str) -> bytes:
    """The key whose text this is."""
    return b"".join(bytes([ord(c) - _RAW]) if _RAW + 0x80 <= ord(c) <= _RAW + 0xFF else c.encode() for c in text) if any(c >= "\uef80" for c in text) else text.encode()
