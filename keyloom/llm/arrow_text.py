"""Numpy work on the bytes of Arrow text columns: words and their hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about this many bytes, to bound the arrays made for each.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * CHUNK_BYTES, n + 1)
    have = _powers.get(0)
    if have is None or len(have[0]) < size:
        both = []
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 2 * CHUNK_BYTES:
            _powers[0] = have
    return have


class Words:
    """The words of some texts: byte buffer, word starts and ends, first word of each text, 64-bit word hashes."""

    __slots__ = ("buf", "starts", "ends", "first", "hashes")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, hashes: bool = True, between: np.ndarray = _SPACE) -> None:
        """``between``: of each byte, whether it separates words; ASCII white space by default."""
        n = len(buf)
        solid = ~between[buf]
        cut = np.zeros(n + 1, bool)  # between two bytes: a text begins
        cut[offsets] = cut[0] = cut[n] = True
        before, after = cut[:n].copy(), cut[1:].copy()
        before[1:] |= ~solid[:-1]
        after[:-1] |= ~solid[1:]
        starts = np.flatnonzero(solid & before)
        ends = np.flatnonzero(solid & after) + 1
        self.buf, self.starts, self.ends = buf, starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.hashes = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.buf)
        up, down = _power(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a text array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, o - o[0]


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of texts of about CHUNK_BYTES: first row, row after the last, bytes, offsets."""
    buf, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, n)
        part = buf[off[i] : off[j]]
        yield i, j, _LOWER[part] if lower else part, off[i : j + 1] - off[i]
        i = j


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9DDFEA08EB382D69)
        h += words[j : j + n]
    return mix(h)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths: the row of each element, and its place in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    return row, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, as (hashes sorted within a text, first of each text).

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    counts = np.diff(words.first)
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    full = gram_hashes(words.hashes, k)
    row, at = ragged(have)
    pos = words.first[:-1][row] + at
    out = np.zeros(len(pos), np.uint64)
    long = counts[row] >= k
    out[long] = full[pos[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        s = words.hashes[words.first[i] : words.first[i + 1]]
        out[np.searchsorted(row, i)] = mix(gram_hashes(s, len(s)) + np.uint64(len(s)))[0]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(counts) + 1))
