"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

Every window of every text gets a fingerprint. Of each item's fingerprint the blocks are filed with all their neighbours of
PROBE bits, so one look-up for each block of a window gives the items that may be near it. Only those are compared: first
whole fingerprints, then the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, chunks, gram_hashes, mix, ragged

#: A fingerprint has 64 bits, in BLOCKS blocks of WIDTH bits. Two fingerprints that differ in RADIUS bits or fewer agree in
#: one block but for PROBE bits, so none within RADIUS is missed. At a similarity of 0.75 a bit differs with a chance of
#: 0.17, and some block is near enough with a chance of 0.92. Of unrelated items 0.8 % get past the blocks.
BLOCKS, WIDTH, PROBE = 4, 16, 2
RADIUS = BLOCKS * (PROBE + 1) - 1
#: Candidates that differ in more of 64 bits, or of those and 64 more bits, are not compared by shingles. At a similarity of
#: 0.75, 11 and 22 are expected, and 32 and 64 of unrelated windows.
CUT, CUT_BOTH = 18, 40
#: Items, and shingles of items, in one pass over the documents; a larger benchmark takes a pass for each block of so many.
BLOCK_ITEMS, BLOCK_GRAMS = 4_000, 1 << 20
#: Windows whose fingerprints are made at a time, and windows and shingles of an item that are compared at a time.
STEP, EXACT, COLUMNS = 16384, 4096, 64
_FLIPS = np.array([sum(1 << b for b in c) for n in range(PROBE + 1) for c in combinations(range(WIDTH), n)], np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1 from n hashes."""
    return np.unpackbits(h.view(np.uint8)).reshape(-1, 64)


def _more(grams: np.ndarray) -> np.ndarray:
    """Hashes for the second half of a fingerprint."""
    return mix(grams ^ np.uint64(0x5851F42D4C957F2D))


def _packed(more: np.ndarray) -> np.ndarray:
    """Words of 64 bits from (n, 64) booleans."""
    return np.packbits(more.reshape(-1)).view(np.uint64)


def block_values(prints: np.ndarray) -> np.ndarray:
    """(BLOCKS, n) block values of fingerprints."""
    return prints.view(np.uint16).reshape(-1, BLOCKS).T.astype(np.int64)


def _sums(bits: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the rows before each row, modulo what ``kind`` holds: within stretches of 128 rows in step, then across them."""
    n = -(-len(bits) // 128)
    out = np.zeros((n * 128 + 1, 64), kind)
    out[1 : len(bits) + 1] = bits
    parts = out[1:].reshape(n, 128, 64)
    for i in range(1, 128):
        parts[:, i] += parts[:, i - 1]
    before = np.zeros((n, 1, 64), kind)
    np.cumsum(parts[:-1, -1], axis=0, dtype=kind, out=before[1:, 0])
    parts += before
    return out[: len(bits) + 1]


def odd(spans):
    """Shingles of a window that make its fingerprint: all, or one less so that no bit is a draw."""
    return spans - 1 + spans % 2


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """The SimHash of a run of shingle hashes, and 64 bits more: a bit is set if more than half of them have it."""
    grams = grams[: odd(len(grams))]
    return tuple(int(_packed(_bits(h).sum(0, dtype=np.int64)[None] > len(grams) // 2).view(np.int64)[0]) for h in (grams, _more(grams)))


def window_words(size: np.ndarray) -> np.ndarray:
    """Words of the windows that are fingerprinted for items of ``size`` words: as many below 16, beyond that cut by less than
    a ninth, so that items of any sizes need few kinds of windows. The comparison by shingles takes all words."""
    size = np.asarray(size, np.int64)
    shift = np.maximum(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 3, 0)
    return size >> shift << shift


@dataclass
class Kind:
    """The items whose windows have the same number of words, and the multi-index of their fingerprints."""

    words: int
    gram: int
    items: np.ndarray
    prints: np.ndarray
    gate: np.ndarray = field(init=False)  # by block value: a bit for each block that has an item near that value
    keys: np.ndarray = field(init=False)  # block << WIDTH | value, sorted
    who: np.ndarray = field(init=False)  # the item near keys[i], by its place in items
    until: np.ndarray = field(init=False)  # where the run of equal keys that holds keys[i] ends

    def __post_init__(self) -> None:
        near = block_values(self.prints[:, 0].copy())[:, :, None] ^ _FLIPS
        self.gate = np.zeros(1 << WIDTH, np.uint8)
        for j in range(BLOCKS):
            self.gate[near[j]] |= np.uint8(1 << j)
        keys = (near | (np.arange(BLOCKS) << WIDTH)[:, None, None]).reshape(-1).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        who = np.tile(np.repeat(np.arange(len(self.items), dtype=np.int32), len(_FLIPS)), BLOCKS)
        self.keys, self.who = keys[order], who[order]
        self.until = np.searchsorted(self.keys, self.keys, side="right")

    def near(self, prints: np.ndarray, use: np.ndarray, cut: int = CUT) -> tuple[np.ndarray, np.ndarray]:
        """(window, item by its place) of the windows marked by ``use`` that are near an item in some block and differ in
        ``cut`` bits at most."""
        values = block_values(prints)
        hit = self.gate.take(values[0]) & np.uint8(1)
        for j in range(1, BLOCKS):
            hit |= self.gate.take(values[j]) & np.uint8(1 << j)
        some = np.flatnonzero((hit > 0) & use)
        which, at = np.nonzero(hit[some] >> np.arange(BLOCKS, dtype=np.uint8)[:, None] & 1)
        at = some[at]
        key = (values[which, at] | which << WIDTH).astype(np.int32)
        lo = np.searchsorted(self.keys, key)
        which, k = ragged(self.until[lo] - lo)
        row, item = at[which], self.who[lo[which] + k]
        close = np.bitwise_count(prints[row] ^ self.prints[item, 0]) <= cut
        both = np.unique(row[close] * len(self.items) + item[close])
        return both // len(self.items), both % len(self.items)

    def nearer(self, grams: np.ndarray, start: np.ndarray, span: int, item: np.ndarray) -> np.ndarray:
        """Whether windows of ``span`` shingles from ``start`` on are near items by all 128 bits."""
        out = np.zeros(len(start), bool)
        step = max(1, (1 << 14) // span)
        for at in range(0, len(start), step):
            rows, mine = start[at : at + step], item[at : at + step]
            h = grams[rows[:, None] + np.arange(span)]
            far = np.zeros(len(rows), np.int64)
            for half, x in enumerate((h, _more(h))):
                prints = _packed(_bits(x.reshape(-1)).reshape(len(rows), span, 64).sum(1, dtype=np.int32) > span // 2)
                far += np.bitwise_count(prints ^ self.prints[mine, half])
            out[at : at + step] = far <= CUT_BOTH
        return out


@dataclass
class Items:
    """A block of benchmark items, ready to be matched."""

    k: int
    ids: np.ndarray
    size: np.ndarray  # words of an item
    grams: list[np.ndarray]  # of each item: its distinct shingles, sorted
    weights: list[np.ndarray]  # and how often each occurs
    kinds: list[Kind]


#: A row for each item: what is broadcast of it.
_FEATURES = "item long, size long, grams array<long>, weights array<long>, low long, high long"


def _features(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Features of (item, text); items without words are left out, one of fewer than k words is its only shingle."""
    for batch in rows:
        out = []
        for i, j, buf, off in chunks(batch.column(1), lower=True):
            w = Words(buf, off)
            for x in range(i, j):
                s = w.hashes[w.first[x - i] : w.first[x - i + 1]]
                if len(s):
                    kk = min(k, len(s))
                    g, n = np.unique(gram_hashes(s, kk), return_counts=True)
                    low, high = fingerprint(gram_hashes(s[: int(window_words(len(s)))], kk))
                    out.append((batch.column(0)[x].as_py(), len(s), g.view(np.int64), n, low, high))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["item", "size", "grams", "weights", "low", "high"])


def index_items(rows: list[tuple], k: int) -> Items:
    """The multi-index of rows of features."""
    size = np.array([r[1] for r in rows], np.int64)
    prints = np.array([(r[4], r[5]) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    words = window_words(size)
    kinds = [Kind(int(n), min(k, int(n)), np.flatnonzero(words == n), prints[words == n]) for n in np.unique(words)]
    return Items(k, np.array([r[0] for r in rows], np.int64), size, [np.array(r[2], np.int64).view(np.uint64) for r in rows], [np.array(r[3], np.int64) for r in rows], kinds)


_held: list = [None, None]


def _index(rows: Broadcast, k: int) -> Items:
    """The index of a broadcast block; a Python worker keeps the last one that it made."""
    if _held[0] is not rows.value:
        _held[:] = rows.value, index_items(rows.value, k)
    return _held[1]


def _shared(items: Items, item: int, grams: np.ndarray, span: int) -> np.ndarray:
    """Of each run of ``span`` shingles: the weight that it shares with an item."""
    mine, weights = items.grams[item], items.weights[item]
    place = np.minimum(np.searchsorted(mine, grams), len(mine) - 1)
    place[mine[place] != grams] = -1
    out = np.zeros(len(grams) - span + 1, np.int64)
    here = np.unique(place[place >= 0])
    for at in range(0, len(here), COLUMNS):
        g = here[at : at + COLUMNS]
        upto = np.zeros((len(grams) + 1, len(g)), np.int32)
        np.cumsum(place[:, None] == g, axis=0, out=upto[1:])
        out += np.minimum(upto[span:] - upto[:-span], weights[g]).sum(axis=1)
    return out


def _best(items: Items, item: int, grams: np.ndarray, words: int, starts: np.ndarray, percent: int) -> tuple[int, int, int, int, int] | None:
    """(item, start, words, shared weight, whole weight) of the best window about ``starts`` in a text of so many words, if
    it reaches the similarity; the first of equals. A text that is shorter than the item is its own only window."""
    size = int(items.size[item])
    k = min(items.k, size)
    n = min(size, words)
    span, weight = n - k + 1, size - k + 1
    reach, best = size // 3 + 1, None
    lo, hi = np.clip(starts - reach, 0, words - n), np.clip(starts + reach, 0, words - n)
    fresh = np.ones(len(lo), bool)  # stretches that touch are one
    fresh[1:] = lo[1:] > np.maximum.accumulate(hi)[:-1] + 1
    for a, b in zip(lo[fresh], np.maximum.reduceat(hi, np.flatnonzero(fresh)), strict=True):
        for at in range(int(a), int(b) + 1, EXACT):
            to = min(at + EXACT, int(b) + 1)
            shared = _shared(items, item, grams[at : to + span - 1], span)
            top = int(np.argmax(shared))
            s = int(shared[top])
            if 100 * s >= percent * (span + weight - s) and (best is None or s > best[3]):
                best = (item, at + top, n, s, span + weight - s)
    return best


def candidates(items: Items, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, start) of the windows of some texts that the multi-index finds near an item."""
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hashes))  # words from here to the end of the text
    rows, found, starts = [], [], []
    kinds_of = (np.uint8, 1 << 8), (np.uint16, 1 << 16), (np.int64, 1 << 62)  # counts of a span below the bound fit
    counts, more = {t: np.empty((STEP, 64), t) for t, _ in kinds_of}, np.empty((STEP, 64), bool)

    def keep(kind: Kind, at: np.ndarray, item: np.ndarray) -> None:
        found.append(kind.items[item]), starts.append(at), rows.append(np.searchsorted(w.first, at, side="right") - 1)

    for k in {kind.gram for kind in items.kinds}:
        grams = gram_hashes(w.hashes, k)
        kinds = [kind for kind in items.kinds if kind.gram == k]
        small = 0
        for count, big in kinds_of:
            mine, small = [kind for kind in kinds if small <= odd(kind.words - k + 1) < big], big
            most = max((odd(kind.words - k + 1) for kind in mine), default=0)
            for at in range(0, len(grams) if mine else 0, STEP):
                sums = _sums(_bits(grams[at : at + STEP + most - 1]), count)
                for kind in mine:
                    span = odd(kind.words - k + 1)
                    m = max(0, min(STEP, len(sums) - span))
                    use = left[at : at + m] >= kind.words
                    if use.any():
                        np.subtract(sums[span : span + m], sums[:m], out=counts[count][:m])
                        np.greater(counts[count][:m], span // 2, out=more[:m])
                        row, item = kind.near(_packed(more[:m]), use)
                        good = kind.nearer(grams, at + row, span, item)
                        keep(kind, at + row[good], item[good])
        # texts that are shorter than the windows of an item: one window each
        words = np.diff(w.first)
        longest = max(kind.words for kind in kinds)
        short = np.flatnonzero((words >= items.k) & (words < longest)) if k == items.k else np.zeros(0, np.int64)
        if len(short):
            spans = odd(words[short] - k + 1)
            row, place = ragged(spans)
            sums = np.add.reduceat(_bits(grams[w.first[short][row] + place]), np.cumsum(spans) - spans, axis=0, dtype=np.int64)
            prints = _packed(sums > (spans // 2)[:, None])
            for kind in kinds:
                row, item = kind.near(prints, words[short] < kind.words)
                keep(kind, w.first[short][row], item)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(found), np.concatenate(starts)


def scan(items: Items, texts: pa.Array, percent: int) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """(row, matches) for every text with a match."""
    if not items.kinds:
        return
    for i, j, buf, off in chunks(texts, lower=True):
        w = Words(buf, off)
        row, item, start = candidates(items, w)
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        edges = np.append(np.flatnonzero(new), len(row))
        found: dict[int, list] = {}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            r, it = int(row[a]), int(item[a])
            base, end = int(w.first[r]), int(w.first[r + 1])
            hit = _best(items, it, gram_hashes(w.hashes[base:end], min(items.k, int(items.size[it]))), end - base, start[a:b] - base, percent)
            if hit:
                found.setdefault(r, []).append(hit)
        for r, hits in found.items():
            yield i + r, hits


def _blocks(benchmark: DataFrame, k: int, item_id: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """Features of the items, made by tasks, in blocks of ``size`` items and BLOCK_GRAMS shingles at most (or one item)."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text_col).cast("string")).where(F.col(item_id).isNotNull() & F.col(text_col).isNotNull())
    block, grams = [], 0
    for r in rows.mapInArrow(lambda batches: _features(batches, k), _FEATURES).toLocalIterator():
        if block and (len(block) == size or grams + len(r["grams"]) > BLOCK_GRAMS):
            yield block
            block, grams = [], 0
        block.append(tuple(r))
        grams += len(r["grams"])
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75, block_items: int = BLOCK_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and benchmark item in it: id, item id, start_word, n_words, shared, total, similarity.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A window has as many words as the item; a
    text of ``k`` or more words that is shorter than the item is one window, with its own number of words. The
    weight of a k-word shingle is how often it occurs; similarity is the sum of the smaller weights over that of the larger
    ones, and a row tells of the most similar window (the first of equals) with 100 * shared >= percent * total.

    Fingerprints find the candidates: all windows within RADIUS bits of an item, and most beyond (see BLOCKS); windows
    about a candidate are compared exactly. Null or empty texts and items match nothing, and a document with a null id is
    returned with that null. Rows that repeat are matched each. A document is never split, so nothing is shuffled; the
    benchmark goes to the executors in blocks of ``block_items`` items, each of which is matched against all documents.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, k, item_id, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _index(shared, k)
            for batch in batches:
                rows, hits = [], []
                for row, found in scan(items, batch.column(1), percent):
                    rows += [row] * len(found)
                    hits += found
                m = np.array(hits, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items.ids[m[:, 0]]), *[pa.array(m[:, c]) for c in range(1, 5)]], names=["id", "item", "start_word", "n_words", "shared", "total"])

        part = source.mapInArrow(run, "id long, item long, start_word long, n_words long, shared long, total long")
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "start_word", "n_words", "shared", "total", (F.col("shared") / F.col("total")).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75, block_items: int = BLOCK_ITEMS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, as ``find_leaks`` finds it; all columns stay."""
    place = docs.columns.index(text_col)
    for block in _blocks(benchmark, k, item_id, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in scan(_index(shared, k), batch.column(place), percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
