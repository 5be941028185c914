"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffers
from .labelled import fold, labelled_sample

#: Bytes per block, blocks per half chunk, width of a byte's vector, filters. A filter sees two blocks; a chunk is two halves, and each half belongs to two chunks.
BLOCK, HALF, WIDE, FILTERS = 4, 96, 8, 16
#: Labelled texts of a class that the network is fitted on at most.
PER_CLASS = 1200


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded place of each text, first half chunk of each text, and starts of half chunks, in blocks."""
    need = np.maximum(1, -(-np.diff(offsets) // BLOCK)) + 1  # a block of zeros closes each text
    first = np.concatenate([[0], np.cumsum(need)])
    halves = -(-need // HALF)
    top = np.concatenate([[0], np.cumsum(halves)])
    row = np.repeat(np.arange(len(need)), halves)
    return first, top, first[row] + (np.arange(top[-1]) - top[row]) * HALF


class Network:
    """Byte vectors, convolution over overlapping windows of 8 bytes, max over chunks, mean and max over a document, logistic."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.5, (256, WIDE)).astype(np.float32), "w": rng.normal(0, 0.2, (2 * BLOCK * WIDE, FILTERS)).astype(np.float32), "c": np.zeros(FILTERS, np.float32), "v": np.zeros(2 * FILTERS, np.float32), "b": np.zeros(1, np.float32)}

    def _forward(self, buf: np.ndarray, off: np.ndarray):
        first, top, starts = _layout(off)
        padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)
        lens = np.diff(off)
        padded[np.arange(len(buf)) + np.repeat(first[:-1] * BLOCK - off[:-1], lens)] = buf
        half = BLOCK * WIDE
        x = self.p["emb"][padded].reshape(-1, half)
        y = x @ self.p["w"][:half]
        y[:-1] += x[1:] @ self.p["w"][half:]
        y[first[1:] - 1] = -1e9  # the closing block begins no window
        tops = np.maximum.reduceat(y, starts, axis=0)
        nxt = np.minimum(np.arange(1, len(tops) + 1), np.repeat(top[1:], np.diff(top)) - 1)
        chunk = np.maximum(tops, tops[nxt]) + self.p["c"]
        act = np.maximum(chunk, 0)
        n = np.diff(top)[:, None]
        vec = np.concatenate([np.add.reduceat(act, top[:-1], axis=0) / n, np.maximum.reduceat(act, top[:-1], axis=0)], axis=1)
        return padded, first, top, starts, y, tops, nxt, act, vec

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each text."""
        vec = self._forward(buf, off)[-1]
        return (vec @ self.p["v"] + self.p["b"]).astype(np.float64)

    def gradients(self, buf: np.ndarray, off: np.ndarray, y_true: np.ndarray) -> dict[str, np.ndarray]:
        padded, first, top, starts, y, tops, nxt, act, vec = self._forward(buf, off)
        err = (1 / (1 + np.exp(-(vec @ self.p["v"] + self.p["b"]))) - y_true).astype(np.float32) / len(y_true)
        out = {"v": vec.T @ err, "b": np.array([err.sum()], np.float32)}
        d = err[:, None] * self.p["v"]
        row = np.repeat(np.arange(len(err)), np.diff(top))
        best = act == np.maximum.reduceat(act, top[:-1], axis=0)[row]
        ties = np.add.reduceat(best.astype(np.float32), top[:-1], axis=0)[row]
        dact = d[row, :FILTERS] / np.diff(top)[row][:, None] + d[row, FILTERS:] * best / ties
        dact *= act > 0
        out["c"] = dact.sum(0)
        dtop = np.zeros_like(tops)
        own = tops >= tops[nxt]
        dtop += dact * own
        np.add.at(dtop, nxt, dact * ~own)
        ends = np.append(starts[1:], len(y))
        dw, demb = np.zeros_like(self.p["w"]), np.zeros_like(self.p["emb"])
        for f in range(FILTERS):
            live = np.flatnonzero(dtop[:, f])
            if not len(live):
                continue
            col = y[:, f]
            at = np.array([s + int(np.argmax(col[s:e])) for s, e in zip(starts[live], ends[live], strict=True)])
            window = padded[at[:, None] * BLOCK + np.arange(2 * BLOCK)]
            g = dtop[live, f]
            dw[:, f] = (self.p["emb"][window].reshape(len(at), -1) * g[:, None]).sum(0)
            np.add.at(demb, window, g[:, None, None] * self.p["w"][:, f].reshape(2 * BLOCK, WIDE))
        return out | {"w": dw, "emb": demb}


def train(sample: list[tuple[str, int]], share: float, epochs: int = 14, batch: int = 32, seed: int = 1) -> Network:
    """Fitted by Adam on texts and labels; log odds are shifted from the sample's share of label 1 to that of all labels."""
    net = Network(seed)
    n = len(sample)
    y = np.array([v for _, v in sample], np.float32)
    ones = float(y.sum())
    if n == 0 or ones in (0, n):
        net.p["b"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    data = [t.encode("utf-8", "replace") for t, _ in sample]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.p["v"] = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    t = 0
    for e in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            pick = order[i : i + batch]
            buf = np.frombuffer(b"".join(data[x] for x in pick), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(data[x]) for x in pick])])
            t += 1
            rate = 0.01 * (1 - e / epochs)
            for k, g in net.gradients(buf, off, y[pick]).items():
                g = g + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    net.p["b"] += np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)) - np.log(ones / (n - ones)))
    return net


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS) -> Network:
    """A network fitted on a sample of the labels that ``keep`` allows."""
    return train(*labelled_sample(docs, labels, "quality", keep, per_class))


def probabilities(net: Network, texts: pa.Array, chunk_bytes: int = 1 << 19) -> np.ndarray:
    """Probability of label 1 for every whole text; a null is empty."""
    buf, off = buffers(texts)
    out, i, n = np.zeros(len(off) - 1), 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + chunk_bytes, side="right")) - 1))
        out[i:j] = net.logits(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j
    return np.round(1 / (1 + np.exp(-np.clip(out, -50, 50))), 6)  # single precision: the last digits depend on what shares a batch


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``: null and empty texts get a score too, rows that repeat the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(net, b.column(1)))], names=["id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), "score")


def keep_quality(docs: DataFrame, net: Network, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns stay."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(net, b.column(place)) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on labels outside fold ``held``, applied to all documents.

    A null doc_id belongs to no fold (held_out false). Without labels of both classes the score is the share of label 1.
    """
    net = fit(docs, labels, fold(F.col("doc_id"), folds) != held)
    out = score(docs, net)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
