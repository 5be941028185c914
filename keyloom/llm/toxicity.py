"""Toxicity by gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, chunks
from .labelled import fold, labelled_sample

#: Labelled texts of a class that are learned from at most.
PER_CLASS = 3000
#: Words of the learned lexicon at most, and words on each side in which a second person counts as near.
LEXICON, NEAR = 500, 6
#: Words of the second person, in the languages of the corpus.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros", "os"]
#: Signs that are written for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in DISGUISE] + [ord("*")]] = True
_BETWEEN = ~(_LETTER | _MARK)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNMASK = _LOWER.copy()
for _a, _b in DISGUISE.items():
    _UNMASK[ord(_a)] = ord(_b)
_UPPER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

FEATURES = ["weight_rate", "weight_sum", "hits", "distinct", "hit_rate", "near_hits", "near_rate", "second_rate", "capital_rate", "capital_words", "shouts", "questions", "punctuation", "marked_rate", "unmasked_hits", "log_words", "word_length"]


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    return Words(np.frombuffer(b"".join(data), np.uint8), off, between=np.zeros(256, bool)).hashes


@dataclass
class Lexicon:
    """Word hashes, sorted, with weights; and those of the second person."""

    keys: np.ndarray
    weights: np.ndarray
    second: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of lexicon words, and their places in the lexicon."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        return hit, at[hit]


def learn_lexicon(sample: list[tuple[str, int]], size: int = LEXICON) -> Lexicon:
    """Words that toxic texts hold more often than others: log odds over two standard errors, by the number of texts."""
    seen = (Counter(), Counter())
    docs = [0, 0]
    for text, y in sample:
        docs[y] += 1
        for _, _, buf, off in chunks(pa.array([text]), lower=True):
            w = Words(buf, off, hashes=False, between=_BETWEEN)
            data = buf.tobytes()
            seen[y].update({data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)})
    found = []
    for word, a in seen[1].items():
        b = seen[0][word]
        if a >= 3:
            odds = np.log((a + 0.5) / (docs[1] - a + 0.5)) - np.log((b + 0.5) / (docs[0] - b + 0.5))
            error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if odds > 2 * error:
                found.append((odds - error, word.decode("utf-8", "replace")))
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:size]
    keys = _hashes([w for _, w in found])
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array([x for x, _ in found])[order] if found else np.zeros(0), np.sort(_hashes(SECOND_PERSON)))


def featurize(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """(texts, features) of whole texts; a null is empty."""
    parts = [_features(buf, off, lex) for _, _, buf, off in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _features(buf: np.ndarray, off: np.ndarray, lex: Lexicon) -> np.ndarray:
    n = len(off) - 1
    w = Words(_LOWER[buf], off, between=_BETWEEN)
    row = np.repeat(np.arange(n), np.diff(w.first))
    words = np.diff(w.first)
    per_word, per_byte = np.maximum(words, 1), np.maximum(np.diff(off), 1)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[buf])])[off])

    def per_text(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, n)[:n]

    hit, at = lex.find(w.hashes)
    second = np.flatnonzero(np.isin(w.hashes, lex.second))
    # how far the nearest second person is, within the text
    if len(second) and len(hit):
        nxt = np.searchsorted(second, hit)
        left, right = second[np.maximum(nxt - 1, 0)], second[np.minimum(nxt, len(second) - 1)]
        near = ((np.abs(hit - left) <= NEAR) & (row[left] == row[hit])) | ((np.abs(hit - right) <= NEAR) & (row[right] == row[hit]))
    else:
        near = np.zeros(len(hit), bool)
    marks = np.concatenate([[0], np.cumsum(_MARK[buf])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    capitals = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    size = w.ends - w.starts
    marked = np.flatnonzero((marks[w.ends] > marks[w.starts]) & (letters[w.ends] - letters[w.starts] >= 2))
    shout = np.flatnonzero((capitals[w.ends] - capitals[w.starts] == size) & (size >= 3))
    unmasked = np.zeros(0, np.int64)
    if len(marked):
        plain = Words(_UNMASK[buf], off, between=~_LETTER)
        got, _ = lex.find(plain.hashes)
        inside = np.isin(plain.starts[got], w.starts[marked])
        unmasked = np.searchsorted(plain.first, got[inside], side="right") - 1
    pairs = np.unique(np.stack([row[hit], at]), axis=1)[0] if len(hit) else np.zeros(0, np.int64)
    weight = per_text(row[hit], lex.weights[at]) if len(hit) else np.zeros(n)
    hits, nears = per_text(row[hit]), per_text(row[hit][near])
    bang, ask = np.zeros(256, bool), np.zeros(256, bool)
    bang[ord("!")], ask[ord("?")] = True, True
    cols = [weight / per_word, weight, hits, per_text(pairs), hits / per_word, nears, nears / per_word, per_text(row[second]) / per_word, of_bytes(_UPPER) / per_byte, per_text(row[shout]) / per_word, of_bytes(bang) / per_byte, of_bytes(ask) / per_byte, of_bytes(_PUNCT) / per_byte, per_text(row[marked]) / per_word, per_text(unmasked), np.log1p(words), per_text(row, size.astype(float)) / per_word]
    return np.stack(cols, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of a fixed depth: a test (feature, threshold) for each inner node in heap order, a value for each leaf."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 8.0) -> Trees:
    """Trees for log loss, split by second-order gain over histograms of quantile bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = float((y * weight).sum() / weight.sum())
    base = float(np.log((mean + 1e-4) / (1 - mean + 1e-4)))
    score = np.full(len(y), base)
    inner = 2**depth - 1
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, p * (1 - p) * weight
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-3, 0, -1)
            gs, hs = g[mine].sum(), h[mine].sum()
            for f, e in enumerate(edges):
                if not len(e) or len(mine) < 2:
                    continue
                gl = np.cumsum(np.bincount(code[mine, f], g[mine], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[mine, f], h[mine], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(code[mine, f], minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(mine) - nl < least)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, i)
            if best[2] >= 0:
                feature[k], threshold[k] = best[1], edges[best[1]][best[2]]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > threshold[k])
        for leaf in range(inner + 1):
            mine = node == leaf + inner
            if mine.any():
                value[leaf] = -rate * g[mine].sum() / (h[mine].sum() + 1)
        score += value[node - inner]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Trees(depth, base, np.array(fs), np.array(ts), np.array(vs))


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the best rising fit of y, by pooling neighbours that fall."""
    pools: list[list[float]] = []  # weighted sum, weight, sum of scores, count
    for i in np.argsort(z, kind="stable"):
        pools.append([y[i] * weight[i], weight[i], z[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[3] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability; a fiftieth of it is the trees' own, so that texts on one step keep their order."""
        if self.trees is None:
            return np.full(len(texts), self.share)
        z = self.trees.logits(featurize(texts, self.lexicon))
        return 0.98 * np.interp(z, *self.knots) + 0.02 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(sample: list[tuple[str, int]], share: float, seed: int = 3) -> Model:
    """The lexicon is learned on two fifths of the texts, trees on two, calibration on one, so that none sees the other's noise.

    Weights restore the share of label 1 among all labels.
    """
    y = np.array([v for _, v in sample], float)
    part = np.zeros(len(sample), int)
    rng = np.random.default_rng(seed)
    for c in (0, 1):  # each fifth has its share of both classes
        mine = np.flatnonzero(y == c)
        part[rng.permutation(mine)] = np.arange(len(mine)) % 5
    lexicon = learn_lexicon([s for s, p in zip(sample, part, strict=True) if p < 2])
    ones = y.sum()
    if len(y) < 10 or ones in (0, len(y)):
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)), share)
    weight = np.where(y == 1, max(share, 1e-3) / (ones / len(y)), max(1 - share, 1e-3) / (1 - ones / len(y)))
    x = featurize(pa.array([t for t, _ in sample], pa.string()), lexicon)
    a, b = (part == 2) | (part == 3), part == 4
    trees = boost(x[a], y[a], weight[a])
    return Model(lexicon, trees, isotonic(trees.logits(x[b]), y[b], weight[b]), share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.3, per_class: int = PER_CLASS, keep: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels outside fold ``held``, applied to every whole text.

    Null and empty texts get a score too, rows that repeat the same one; a null doc_id belongs to no fold (held_out false).
    Without labels of both classes the score is the share of label 1.
    """
    held_out = fold(F.col("doc_id"), folds) == held
    model = train(*labelled_sample(docs, labels, "toxic", ~held_out if keep is None else keep, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)))], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = source.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
