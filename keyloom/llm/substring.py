"""Repeated passages, found by recompression and removed.

Runs of equal words and then pairs of symbols get names that are hashes of what they stand for, so equal passages get
equal names in every document without a dictionary. Whether two neighbours make a pair depends on their names alone, so
the symbols inside a passage do not depend on what surrounds it, but for a few words at its edges. Each window of words is
filed under one symbol inside it (with the words that decide that symbol); windows whose symbol no other document has are
settled, those with a shared symbol are then compared themselves.

A window of 13 words fixes symbols of two rounds (runs, pairs) only: deeper rounds need more words on each side than it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, chunks, gram_hashes, mix, ragged
from .tables import join_frequent

#: Words of a window.
WINDOW = 13
#: Pairs (hash, document) that a task gathers before it passes them on.
FLUSH = 1_500_000
_C = np.uint64(0x9DDFEA08EB382D69)
_INV = np.uint64(pow(0x9DDFEA08EB382D69, -1, 2**64))


def _span_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of words[lo:hi] for each pair of bounds, the same wherever the words stand."""
    n = len(words)
    up, down = np.full(n + 1, _C, np.uint64), np.full(n + 1, _INV, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (in words) of what decides each symbol of the second round; they rise from symbol to symbol."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head = np.ones(n, bool)
    head[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], n)
    name = mix(words[begin] + (end - begin).astype(np.uint64) * _C)  # runs; one reaches from begin to end, its neighbours show that it ends there
    doc = row[begin]
    right = (name >> np.uint64(17)) & np.uint64(1) == 1
    pair = np.zeros(len(begin), bool)
    pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    second = np.zeros(len(begin), bool)
    second[1:] = pair[:-1]
    start = np.flatnonzero(~second)
    last = start + pair[start]
    # a symbol's neighbours decide that it is not part of another pair, and the words next to them where their runs end
    same_left = (start > 0) & (doc[np.maximum(start - 1, 0)] == doc[start])
    lo = np.where(same_left, begin[np.maximum(start - 1, 0)] - 1, begin[start] - 2)
    nxt = np.minimum(last + 1, len(begin) - 1)
    same_right = (last + 1 < len(begin)) & (doc[nxt] == doc[start])
    hi = np.where(same_right, end[nxt] + 1, end[last] + 2)
    return lo, hi


def file_windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of some texts: its text, its hash, and the hash that it is filed under.

    The latter is the smallest hash among the symbols decided by words of the window, or the window's own if there is none.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row, at = ragged(counts)
    start = first[:-1][row] + at
    if not len(start):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    window = gram_hashes(words, size)[start]
    lo, hi = _symbols(words, first)
    name = _span_hashes(words, np.clip(lo, 0, len(words)), np.clip(hi, 0, len(words)))
    a = np.searchsorted(lo, start)
    b = np.searchsorted(hi, start + size, side="right")
    none = np.uint64(2**64 - 1)
    low = np.full(len(start), none)
    for d in range(int(np.max(b - a, initial=0))):
        live = np.flatnonzero(a + d < b)
        low[live] = np.minimum(low[live], name[a[live] + d])
    filed = np.where(b > a, low, mix(window ^ _C))
    return row, window, filed


def _distinct(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
    return h[keep], ids[keep]


def _group_firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(head)
    return at, np.repeat(at, np.diff(np.append(at, len(h))))


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, sure) from (hashes, ids): of each hash that a task holds one row, that of its smallest id, is open.

    The ids after the smallest are sure to share it, and if ``whole`` so is the smallest; so a hash that very many
    documents share gives an open row for each task only.
    """

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ids = _distinct(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        at, first = _group_firsts(h)
        later = np.flatnonzero(ids > ids[first])
        sure = np.concatenate([later, np.unique(first[later])]) if whole else later
        rows = np.concatenate([at, sure])
        return pa.RecordBatch.from_arrays([pa.array(h[rows].view(np.int64)), pa.array(ids[rows]), pa.array(np.arange(len(rows)) >= len(at))], names=["h", "id", "sure"])

    held, n = [], 0
    for h, ids in parts:
        held.append((h, ids))
        n += len(h)
        if n >= FLUSH:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def _shared(rows: DataFrame, whole: bool) -> DataFrame:
    """(id, hashes) of the hashes that a document shares with a smaller id, or with any if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0, id0 = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            h, ids, sure = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            done_h, done_id = h[sure], ids[sure]
            h, ids = np.concatenate([h0, h[~sure]]), np.concatenate([id0, ids[~sure]])
            if len(h):
                at, first = _group_firsts(h)
                later = np.flatnonzero(ids > ids[first])
                hit = np.concatenate([later, np.unique(first[later])]) if whole else later
                done_h, done_id = np.concatenate([done_h, h[hit]]), np.concatenate([done_id, ids[hit]])
                h0, id0 = h[at[-1] : at[-1] + 1], ids[at[-1] : at[-1] + 1]  # the first of the last hash: the next batch may go on with it
            yield pa.RecordBatch.from_arrays([pa.array(done_id), pa.array(done_h)], names=["id", "h"])

    dealt = rows.repartition(F.when(F.col("sure"), F.xxhash64("id", "h")).otherwise(F.col("h"))).sortWithinPartitions("sure", "h", "id")
    return dealt.mapInArrow(run, "id long, h long").groupBy("id").agg(F.collect_set("h").alias("hashes"))


def _in_list(values: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    if not len(allowed):
        return np.zeros(len(values), bool)
    allowed = np.sort(allowed)
    at = np.minimum(np.searchsorted(allowed, values), len(allowed) - 1)
    return allowed[at] == values


def _list(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if column[i].is_valid else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, and with ``with_text`` the kept text.

    Words are runs of bytes other than ASCII white space, unchanged; a window is ``size`` consecutive words of a document.
    Each word covered by a window whose words also start somewhere in a document with a smaller id is removed; windows are
    judged on the input. The kept words are joined by blanks.

    A null or empty text, or one of fewer than ``size`` words, loses nothing; so does a row with a null id, which is also
    no source for others. Rows that share an id take nothing from each other. Only the id and text columns are read.

    Texts that are equal as a whole are settled first (all but the smallest id lose every word). No hash's documents are
    gathered: tasks pass on one row for each hash they hold, and sorted rows are read in passing.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    real = source.where("id is not null and text is not null")
    marks = real.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    lowest = marks.groupBy("t1", "t2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("t1", "t2", "lo", "n")
    copies = join_frequent(marks, lowest, ["t1", "t2"], "id").where("id > lo").select("id", "t1", "t2").distinct()
    copies = copies.groupBy("id").agg(F.collect_set("t1").alias("copies"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for i, j, buf, off in chunks(batch.column(1)):
                    w = Words(buf, off)
                    row, _, filed = file_windows(w.hashes, w.first, size)
                    new = np.ones(len(row), bool)
                    new[1:] = (filed[1:] != filed[:-1]) | (row[1:] != row[:-1])
                    yield filed[new], ids[i:j][row[new]]

        yield from _gathered(parts(), True)

    shared = _shared(real.mapInArrow(files, "h long, id long, sure boolean"), True)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids, allowed = batch.column(0).to_numpy(), batch.column(2)
                for i, j, buf, off in chunks(batch.column(1)):
                    w = Words(buf, off)
                    row, window, filed = file_windows(w.hashes, w.first, size)
                    lists = [_list(allowed, k) for k in range(i, j)]
                    # a file's number and its text in one key
                    tag = mix(np.arange(j - i, dtype=np.uint64))
                    keys = np.concatenate([x ^ tag[k] for k, x in enumerate(lists)]) if lists else np.zeros(0, np.uint64)
                    hit = _in_list(filed ^ tag[row], keys)
                    yield window[hit], ids[i:j][row[hit]]

        yield from _gathered(parts(), False)

    # an exact copy of a smaller document is settled; the smallest stands for all
    named = real.join(shared, "id").join(copies, "id", "left").where(~F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False))).select("id", "text", "hashes")
    gone = _shared(named.mapInArrow(windows, "h long, id long, sure boolean"), False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                w = Words(buf, off)
                grams = gram_hashes(w.hashes, size)
                n, lost, digest, texts = np.diff(w.first), np.zeros(j - i, np.int64), [], []
                for k in range(j - i):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    away = np.zeros(b - a, bool)
                    if b - a >= size:
                        if batch.column(3)[i + k].as_py():
                            away[:] = True
                        else:
                            starts = np.flatnonzero(_in_list(grams[a : b - size + 1], _list(batch.column(2), i + k)))
                            edge = np.zeros(b - a + 1, np.int64)
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + size, -1)
                            away = np.cumsum(edge)[:-1] > 0
                    lost[k] = away.sum()
                    data = buf[off[k] : off[k + 1]].tobytes().split()
                    kept = b" ".join(x for x, g in zip(data, away, strict=True) if not g) if lost[k] else b" ".join(data)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "replace") if with_text else None)
                cols = [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(lost), pa.array(digest, pa.string())]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    known = source.join(gone, "id", "left").join(copies, "id", "left")
    known = known.select("id", "text", "hashes", F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False)).alias("copy"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return known.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


#: Every window with the smallest document that starts it; positions covered by one of a smaller document go.
ORACLE = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {WINDOW}], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS pos FROM words WHERE len(w) >= {WINDOW})
), firsts AS (SELECT win, min(doc_id) AS lo FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT x.doc_id, x.pos + o.k AS pos FROM windows x JOIN firsts f ON x.win = f.win AND f.lo < x.doc_id, (SELECT unnest(range({WINDOW})) AS k) o
), each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words
), sums AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN e.word END, ' ' ORDER BY e.pos) AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN sums USING (doc_id)
"""
