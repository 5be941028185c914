"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Frequent words are compiled, with their token ids as outputs, into an automaton that shares suffixes; it is stored as flat
arrays in one file that executors memory-map. Other words are merged exactly, many at a time, in numpy.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import mmap
import os
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import ragged

#: Words of the vocabulary that are compiled into the automaton at most; they come in the order of their ids, which is that of frequency.
LEXICON_WORDS = 60_000
#: Characters of a batch of texts that are encoded together.
BATCH_CHARS = 2_000_000
#: Words of more bytes are merged one by one, in time that hardly grows faster than their length.
LONG = 128
#: Pieces that a worker remembers, and their characters.
PIECES, PIECE_CHARS = 400_000, 20_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a tokenizer file says: tokens, merges, word pattern, special tokens."""

    tokens: list[str]
    end: str
    pattern: str
    specials: dict[str, int]
    byte_id: np.ndarray  # token of a byte inside a word
    last_id: np.ndarray  # token of a byte that ends a word
    keys: np.ndarray  # left * n + right of each merge, sorted
    ranks: np.ndarray
    made: np.ndarray  # token that the merge makes
    words: list[tuple[bytes, int]] = field(default_factory=list)  # whole words of the vocabulary, by id


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE tokenizer file whose words carry an end marker and whose alphabet is that of bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
    vocab: dict[str, int] = model["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *specials.values()]) + 1
    tokens = [""] * n
    for t, i in [*vocab.items(), *specials.items()]:
        tokens[i] = t
    symbols = byte_symbols()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    key = np.array([vocab[a] * n + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    key, first = np.unique(key[::-1], return_index=True)  # a pair that is listed twice has its last rank
    rank = len(merges) - 1 - first
    back = {s: b for b, s in enumerate(symbols)}
    words = []
    for t, i in vocab.items():
        if end and t.endswith(end) and t not in specials and len(t) > len(end) and all(c in back for c in t[: -len(end)]):
            words.append((bytes(back[c] for c in t[: -len(end)]), i))
    words.sort(key=lambda w: w[1])
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(tokens, end, split, specials, np.array([vocab[s] for s in symbols], np.int64), np.array([vocab[s + end] for s in symbols], np.int64), key, rank, made[rank], words)


class Merger:
    """Exact merging of many words at a time."""

    def __init__(self, v: Vocabulary) -> None:
        self.n, self.byte_id, self.last_id = len(v.tokens), v.byte_id, v.last_id
        bits = max(16, int(np.ceil(np.log2(4 * max(1, len(v.keys))))))
        self.shift = np.uint64(64 - bits)
        self.slot = np.full((1 << bits) + 64, -1, np.int64)
        self.keys, self.ranks, self.made = v.keys, v.ranks, v.made
        for i, h in enumerate(self._hash(v.keys).tolist()):
            while self.slot[h] >= 0:
                h += 1
            self.slot[h] = i
        self.places: dict[int, tuple[int, int]] | None = None

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        h = self._hash(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            s = self.slot[h[todo]]
            hit = s >= 0
            todo, s = todo[hit], s[hit]
            same = self.keys[s] == key[todo]
            out[todo[same]] = s[same]
            todo = todo[~same]
            h[todo] += 1
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of word i are ids[first[i]:first[i + 1]]."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge_short(words)
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            ids, first = self._merge_short([words[i] for i in short])
            for n, i in enumerate(short):
                parts[i] = ids[first[n] : first[n + 1]]
        for i in long:
            parts[i] = self._merge_long(words[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word's ids: pairs wait in a heap by rank and place, and a merge adds the two pairs that it makes."""
        if self.places is None:
            self.places = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        buf = np.frombuffer(word, np.uint8)
        start = self.byte_id[buf]
        start[-1] = self.last_id[buf[-1]]
        found = self._find(start[:-1] * self.n + start[1:])
        at = np.flatnonzero(found >= 0)
        heap = ((self.ranks[found[at]] << 32) | at).tolist()
        heapify(heap)
        ids, n, places = start.tolist(), self.n, self.places
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue
            pair = places.get(ids[i] * n + ids[j])
            if pair is None or pair[0] != x >> 32:
                continue  # one of the two has been merged since
            ids[i], ids[j] = pair[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if pair := places.get(ids[i] * n + ids[k]):
                    heappush(heap, pair[0] << 32 | i)
            h = before[i]
            if h >= 0 and (pair := places.get(ids[h] * n + ids[i])):
                heappush(heap, pair[0] << 32 | h)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge. In each round every word that still has a pair to merge merges its leftmost pair of the lowest rank, as
        one merge after the other does."""
        lens = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte_id[buf]
        ends = np.cumsum(lens)
        ids[ends - 1] = self.last_id[buf[ends - 1]]
        none = np.int64(1 << 40)
        final: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        name = np.arange(len(words))
        while len(name):
            row, at = ragged(lens)
            place = np.full(len(ids), -1, np.int64)
            inner = np.flatnonzero(at < lens[row] - 1)
            place[inner] = self._find(ids[inner] * self.n + ids[inner + 1])
            rank = np.where(place >= 0, self.ranks[place], none)
            first = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank * 1, first)
            done = best == none
            if done.any():
                out = done[row]
                final.append((name[done], lens[done], ids[out]))
                live = ~out
                ids, rank, place, row, at = ids[live], rank[live], place[live], row[live], at[live]
                name, lens, best = name[~done], lens[~done], best[~done]
                if not len(name):
                    break
                row, at = ragged(lens)
            hit = np.flatnonzero(rank == best[row])
            lead = np.ones(len(hit), bool)
            lead[1:] = row[hit][1:] != row[hit][:-1]
            hit = hit[lead]
            ids[hit] = self.made[place[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids = ids[keep]
            lens = lens - 1
        size = np.zeros(len(words), np.int64)
        for who, n, _ in final:
            size[who] = n
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(first[-1], np.int64)
        for who, n, got in final:
            row, at = ragged(n)
            flat[first[who][row] + at] = got
        return flat, first


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, as one block of bytes.

    Words are added in order and finished states are shared when they have the same arcs (byte, target, count of words
    passed over). The counts along a path add up to the word's number in order, which finds its ids. Layout: six int64
    sizes, then the arrays first arc, final, arc byte, arc target, arc count, first id, ids (int32 but for arc byte).
    """
    order = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))
    counts: list[int] = []
    path: list[tuple[bool, list]] = [(False, [])]

    def finish(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            sign = (final, tuple(arcs))
            if sign not in register:
                register[sign] = len(states)
                states.append(sign)
                counts.append(final + sum(counts[s] for _, s in arcs))
            path[-1][1][-1] = (path[-1][1][-1][0], register[sign])

    before = b""
    for word in order:
        same = os.path.commonprefix([before, word])
        finish(len(same))
        for c in word[len(same) :]:
            path[-1][1].append((c, -1))
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        before = word
    finish(0)
    final, arcs = path[0]
    states.append((final, tuple(arcs)))
    first, byte, target, number = [0], [], [], []
    for final, arcs in states:
        passed = int(final)
        for c, s in arcs:
            byte.append(c), target.append(s), number.append(passed)
            passed += counts[s]
        first.append(len(byte))
    ids = [i for w in order for i in entries[w]]
    starts = np.concatenate([[0], np.cumsum([len(entries[w]) for w in order])]) if order else np.zeros(1)
    arrays = [np.array(first, np.int32), np.array([s[0] for s in states], np.int32), np.array(byte, np.int32), np.array(target, np.int32), np.array(number, np.int32), starts.astype(np.int32), np.array(ids, np.int32)]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled automaton over a buffer, which may be a mapped file."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        sizes = np.frombuffer(data, np.int64, 7)
        at, parts = 56, []
        for n in sizes.tolist():
            parts.append(np.frombuffer(data, np.int32, n, at))
            at += 4 * n
        self.first, self.final, byte, self.target, self.number, self.starts, self.ids = parts
        states = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.arcs = states.astype(np.int64) * 256 + byte  # sorted: states in order, and bytes within a state
        self.root = len(self.first) - 2

    @staticmethod
    def mapped(path: str) -> Lexicon:
        with open(path, "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1; all words walk the automaton in step."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.arcs) or not words:
            return out
        lens = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lens) - lens
        live, state, number, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            over = lens[live] == step
            fit = over & (self.final[state] == 1)
            out[live[fit]] = number[fit]
            live, state, number = live[~over], state[~over], number[~over]
            key = state * 256 + buf[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            good = self.arcs[arc] == key
            live, arc = live[good], arc[good]
            number, state = number[good] + self.number[arc], self.target[arc].astype(np.int64)
            step += 1
        return out


class _Numbers(dict):
    """Numbers its keys in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Encodes and decodes texts; one for each Python worker."""

    def __init__(self, v: Vocabulary, lexicon: Lexicon, memory: int = PIECES, chars: int = PIECE_CHARS) -> None:
        self.v, self.lexicon, self.merger, self.memory, self.chars = v, lexicon, Merger(v), memory, chars
        self.find = regex.compile(v.pattern).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(v.specials, key=len, reverse=True))) if v.specials else None
        self.token = np.array(v.tokens, object)
        self.seen, self.held = _Numbers(), 0  # pieces met so far and their characters; emptied when there are more than memory or chars
        self.flat, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _normal(self, text: str) -> str:
        """White space runs need not become blanks: no word holds any."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # lower case without context: a final sigma as any other

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the first of each: of frequent ones from the automaton, of the others by merging."""
        words = [w.encode("utf-8") for w in new]
        number = self.lexicon.numbers(words)
        rest = np.flatnonzero(number < 0)
        ids, first = self.merger.merge([words[i] for i in rest]) if len(rest) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        size = np.zeros(len(new), np.int64)
        known = np.flatnonzero(number >= 0)
        size[known] = np.diff(self.lexicon.starts)[number[known]]
        size[rest] = np.diff(first)
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(begin[-1], np.int64)
        row, at = ragged(size[known])
        flat[begin[:-1][known][row] + at] = self.lexicon.ids[self.lexicon.starts[number[known]][row] + at]
        row, at = ragged(size[rest])
        flat[begin[:-1][rest][row] + at] = ids
        return flat, begin

    def _know(self) -> None:
        """Ids of the pieces that are new: each is cut into words, and the words' ids are put together."""
        new = list(self.seen)[len(self.first) - 1 :]
        self.held += sum(map(len, new))
        words, counts, at = _Numbers(), [], []
        for piece in new:
            found = self.find(piece)
            at += map(words.__getitem__, found)
            counts.append(len(found))
        flat, first = self._learn(list(words))
        at_ = np.array(at, np.int64)
        size = np.diff(first)[at_]
        row, k = ragged(size)
        self.flat = np.concatenate([self.flat, flat[first[at_][row] + k]])
        begin = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        self.first = np.concatenate([self.first, self.first[-1] + begin])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts; special tokens that stand in a text keep their ids.

        A text is cut at blanks and newlines first, so that a piece met before costs one look-up.
        """
        if len(self.seen) > self.memory or self.held > self.chars:
            self.seen, self.held, self.flat, self.first = _Numbers(), 0, np.zeros(0, np.int64), np.zeros(1, np.int64)
        number, parts, counts = self.seen.__getitem__, [], []
        for text in texts:
            before = len(parts)
            for piece, special in self._pieces(text or ""):
                if special is not None:
                    parts.append(-1 - special)
                else:
                    parts += map(number, self._normal(piece).replace("\n", " ").split(" "))
            counts.append(len(parts) - before)
        if len(self.seen) > len(self.first) - 1:
            self._know()
        at = np.array(parts, np.int64)
        plain = at >= 0
        size = np.ones(len(at), np.int64)
        size[plain] = np.diff(self.first)[at[plain]]
        row, k = ragged(size)
        ids = -1 - at[row]
        own = plain[row]
        ids[own] = self.flat[self.first[ids[own] * -1 - 1] + k[own]]
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        if self.special is None or not self.special.search(text):
            yield text, None
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield "", self.v.specials[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks, special ones included: the file names no decoder."""
        return " ".join(self.token[ids].tolist())


_codecs: dict[str, Codec] = {}


def _codec(name: str, v: Vocabulary) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(v, Lexicon.mapped(SparkFiles.get(name)))
    return _codecs[name]


def prepare(spark: SparkSession, path: str, words: int = LEXICON_WORDS):
    """Compile the lexicon of the vocabulary's whole words and give it and the vocabulary to the executors: (file name, broadcast)."""
    v = load_vocabulary(path)
    merger = Merger(v)
    chosen = [w for w, _ in v.words[:words]]
    ids, first = merger.merge(chosen) if chosen else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    data = compile_lexicon({w: ids[first[i] : first[i + 1]].tolist() for i, w in enumerate(chosen)})
    v.words = []
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp(prefix="lexicon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(os.path.join(folder, name))  # Spark's own file server hands the driver's file to each executor
    return name, spark.sparkContext.broadcast(v)


def encode_documents(docs: DataFrame, path: str, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded text of every whole text, row for row; a null text is empty and has no ids.

    Only the id and text columns are read. Rows that repeat are encoded each; an empty table gives an empty result.
    """
    name, shared = prepare(docs.sparkSession, path, words)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared.value)
        for batch in batches:
            for part in _parts(batch):
                ids = codec.encode(part.column(1).to_pylist())
                first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first), pa.array(flat)), pa.array([codec.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    return source.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of BATCH_CHARS bytes of text or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, done = 0, 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, done + BATCH_CHARS, side="right")))
        yield batch.slice(i, j - i)
        i, done = j, int(size[j - 1])


def encode_digests(docs: DataFrame, path: str, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256 (decoded text in UTF-8) of every whole text.

    A null or empty text has no tokens, and its digests are those of nothing. Rows that repeat, and null ids, are returned
    each; only the id and text columns are read; an empty table gives an empty result.
    """
    name, shared = prepare(docs.sparkSession, path, words)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared.value)
        for batch in batches:
            for part in _parts(batch):
                ids = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string())], names=["id", "n", "a", "b"])

    out = source.mapInArrow(run, "id long, n long, a string, b string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("ids_sha256"), F.col("b").alias("decoded_sha256"))
