"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffers

#: Characters per gram; each character is a code of BITS bits, so a gram is one integer whose prefix and suffix are shifts of it.
ORDER, BITS = 4, 14
#: Grams of the highest order, of all languages, that one pass over the texts holds; more grams take more passes, none is left out.
MODEL_GRAMS = 1 << 20
#: The sharpness of a score is one of these, or SHARPNESS if no document tells of it. Of CALIBRATION folds, one is for that.
GRID, SHARPNESS, CALIBRATION = np.geomspace(0.05, 100, 64), 6.0, 5
#: A text is rejected if its cross-entropy is above what this share of the calibration texts of that language and length
#: have; lengths are classed by powers of two. A class of fewer than ENOUGH texts rejects nothing. Histograms have BIN wide bins.
ACCEPTED, ENOUGH, BIN = 0.995, 20, 0.05
#: Characters handled at a time.
CHUNK = 1 << 20


def _codes() -> np.ndarray:
    """Code of each code point: 0 for what is no letter, else its own below 8192, in which most alphabets lie, and one of 8192
    more beyond; capitals have that of their small letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low if low < 8192 else 8192 + (low * 2654435761 >> 7) % 8192
    return out


_table: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    if not _table:
        _table.append(_codes())
    return _table[0]


def _characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters of UTF-8 texts, and the first character of each."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = np.searchsorted(at, off)
    wide = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _code_table()[wide], first


def _grams(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every text as integers and the first of each: runs of non-letters count as one blank, and each text is
    preceded by ORDER - 1 blanks and ends with one."""
    n = len(first) - 1
    blank = codes == 0
    start = np.zeros(len(codes) + 1, bool)
    start[first] = True
    again = np.zeros(len(codes), bool)
    again[1:] = blank[1:] & blank[:-1]
    again |= blank & start[:-1]  # a leading blank repeats the ones before the text
    keep = ~again
    upto = np.concatenate([[0], np.cumsum(keep)])
    size = np.diff(upto[first])
    begin = np.concatenate([[0], np.cumsum(size + ORDER)])
    seq = np.zeros(begin[-1] + ORDER, np.int64)
    kept = codes[keep]
    seq[np.arange(len(kept)) + np.repeat(begin[:-1] + ORDER - 1 - upto[first][:-1], size)] = kept
    g = np.zeros(begin[-1], np.int64)
    for j in range(ORDER):
        g = (g << BITS) | seq[j : j + len(g)]
    # one gram ends at each kept character and one at the closing blank: drop those that end in the blanks before a text
    ok = np.ones(len(g), bool)
    for j in range(1, ORDER):
        ok[begin[1:] - j] = False
    first_gram = begin - (ORDER - 1) * np.arange(n + 1)
    return g[ok], first_gram


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, row after the last, grams, first gram of each text, letters of each text."""
    buf, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1))
        codes, first = _characters(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        letters = np.diff(np.concatenate([[0], np.cumsum(codes > 0)])[first])
        yield i, j, *_grams(codes, first), letters
        i = j


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over every whole text with a language; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shift = ORDER * BITS

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = merged()
            who = np.array(list(names), object)[keys >> shift]
            return pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(keys & ((1 << shift) - 1)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            if len(names) + len(set(langs)) > 1 << 62 - shift:  # a language's number must fit above a gram
                if held:
                    yield out()
                names, held = {}, []
            for i, j, grams, first, _ in _pieces(batch.column(1)):
                lang = np.array([names.setdefault(x, len(names)) for x in langs[i:j]], np.int64)
                held.append(np.unique((np.repeat(lang, np.diff(first)) << shift) | grams, return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:  # many distinct grams: pass them on, counts add up later
                    yield out()
                    held = []
        if held:
            yield out()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(ones: float, twos: float) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Whole(NamedTuple):
    """What a language's grams tell only all together: discounts from the lowest order to the highest, and the grams of
    orders 1 and 2 with the number of characters seen before them."""

    discounts: list[float]
    low: list[tuple[np.ndarray, np.ndarray]]


class Model:
    """Interpolated Kneser-Ney probabilities of one language, in sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int, whole: Whole | None = None) -> None:
        """grams sorted. The highest order uses counts, the lower ones the number of characters seen before a gram.

        With ``whole``, grams may be those of a shard: the ones with some pairs of characters in the middle. Their
        contexts and their tails of order 3 are in no other shard.
        """
        self.keys, self.probs, self.rest = [], [], []
        levels = [(grams, counts.astype(np.float64))]
        for o in range(ORDER - 1, 0, -1):
            tails = levels[-1][0] & ((1 << (o * BITS)) - 1)
            levels.append(tuple(np.unique(tails, return_counts=True)) if whole is None or o > 2 else whole.low[o - 1])
        lower: np.ndarray | None = None
        self.floor = 1.0 / (alphabet + 1)
        for o, (g, n) in enumerate(reversed(levels), 1):
            d = _discount(float((n == 1).sum()), float((n == 2).sum())) if whole is None else whole.discounts[o - 1]
            ctx, at = np.unique(g >> BITS, return_inverse=True)
            total = np.bincount(at, n)
            kinds = np.bincount(at)
            weight = d * kinds / total
            below = self.floor if lower is None else self._at(o - 1, g & ((1 << ((o - 1) * BITS)) - 1))
            p = (n - d) / total[at] + weight[at] * below
            self.keys.append(g)
            self.probs.append(p)
            self.rest.append((ctx, weight))
            lower = p

    def _at(self, o: int, g: np.ndarray) -> np.ndarray:
        """Probability of the last character of grams of order ``o`` after the others."""
        if o == 0:
            return np.full(len(g), self.floor)
        keys, probs = self.keys[o - 1], self.probs[o - 1]
        out = np.zeros(len(g))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[hit] = probs[at[hit]]
            miss = np.flatnonzero(~hit)
        else:
            miss = np.arange(len(g))
        if len(miss):
            ctx, weight = self.rest[o - 1]
            w = np.ones(len(miss))
            if len(ctx):
                c = np.minimum(np.searchsorted(ctx, g[miss] >> BITS), len(ctx) - 1)
                known = ctx[c] == g[miss] >> BITS
                w[known] = weight[c[known]]
            out[miss] = w * self._at(o - 1, g[miss] & ((1 << ((o - 1) * BITS)) - 1))
        return out

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each gram's last character."""
        return np.log(np.maximum(self._at(ORDER, grams), 1e-12)).astype(np.float32)


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each gram, by its two characters in the middle."""
    return ((grams >> BITS & (1 << 2 * BITS) - 1) * 2654435761 >> 16) % shards


@dataclass
class Models:
    """Models of all languages over every gram that was counted, built shard by shard."""

    names: list[str]
    counts: DataFrame  # lang, gram, n
    shards: int
    alphabet: int
    whole: dict[str, Whole]

    def shard(self, s: int) -> list[Model]:
        """The models of one shard, in the order of names."""
        mine = self.counts.where(F.expr(f"((shiftright(gram, {BITS}) & {(1 << 2 * BITS) - 1}) * 2654435761L >> 16) % {self.shards} = {s}"))
        parts = _by_language(mine.select("lang", "gram", "n").toArrow())
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return [Model(*parts.get(x, none), self.alphabet, self.whole[x]) for x in self.names]


def _by_language(table: pa.Table) -> dict[str, tuple[np.ndarray, ...]]:
    """Columns after the first of each language's rows, in the order of the second."""
    langs = table.column(0).combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    code, columns = langs.indices.to_numpy(), [c.to_numpy() for c in table.columns[1:]]
    order = np.lexsort((columns[0], code))
    cuts = np.searchsorted(code[order], np.arange(len(langs.dictionary) + 1))
    return {x: tuple(c[order[cuts[i] : cuts[i + 1]]] for c in columns) for i, x in enumerate(langs.dictionary.to_pylist())}


def models_of(counts: DataFrame, model_grams: int = MODEL_GRAMS) -> Models:
    """Models from staged counts. The driver gets a row for each language and each pair of characters, and a shard at a time."""
    top = {r["lang"]: r for r in counts.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
    tails = counts.groupBy("lang", F.col("gram").bitwiseAND((1 << 3 * BITS) - 1).alias("gram")).agg(F.count("*").alias("n"))
    pairs = tails.groupBy("lang", F.col("gram").bitwiseAND((1 << 2 * BITS) - 1).alias("pair"))
    two = _by_language(pairs.agg(F.count("*").alias("n"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).toArrow())
    whole, letters = {}, [np.zeros(0, np.int64)]
    for lang, (pair, n, ones, twos) in two.items():
        one = np.unique(pair & (1 << BITS) - 1, return_counts=True)
        low = [_discount(float((c == 1).sum()), float((c == 2).sum())) for c in (one[1], n)]
        whole[lang] = Whole([*low, _discount(float(ones.sum()), float(twos.sum())), _discount(float(top[lang]["ones"]), float(top[lang]["twos"]))], [one, (pair, n)])
        letters.append(one[0])
    return Models(sorted(top), counts, max(1, -(-sum(r["n"] for r in top.values()) // model_grams)), len(np.unique(np.concatenate(letters))), whole)


def fit(docs: DataFrame, model_grams: int = MODEL_GRAMS, text_col: str = "text", lang_col: str = "lang") -> Models:
    """A model for each language, from all grams of all of ``docs``."""
    from .tables import stage_table

    return models_of(stage_table(count_grams(docs, text_col, lang_col), "lang-grams"), model_grams)


def _scored(source: DataFrame, models: Models, finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``finish`` makes of rows of ``source`` (text first), their cross-entropies (language, row), grams and letters.

    Each shard of the models takes a pass that adds its part to each row's sums; between passes the rows are staged, so
    that a task holds one shard.
    """
    from .tables import stage_table

    names, shards, columns = len(models.names), models.shards, source.columns
    rows = source.withColumn("sums_", F.array().cast("array<double>"))
    for s in range(shards):
        shared = source.sparkSession.sparkContext.broadcast(models.shard(s))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, s=s) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            logs = np.zeros((names, 0), np.float32)
            for batch in batches:
                for i, j, grams, first, letters in _pieces(batch.column(0)):
                    sums, size = np.zeros((names, j - i)), np.diff(first)
                    if names and len(grams):
                        kinds, at = np.unique(grams, return_inverse=True)
                        place = np.minimum(np.searchsorted(seen, kinds), max(0, len(seen) - 1))
                        new = seen[place] != kinds if len(seen) else np.ones(len(kinds), bool)
                        if new.any():  # probabilities of grams met before are kept
                            if len(seen) > 1_000_000:
                                seen, logs, new = seen[:0], logs[:, :0], np.ones(len(kinds), bool)
                            fresh = kinds[new]
                            more, mine = np.zeros((names, len(fresh)), np.float32), _shard(fresh, shards) == s
                            more[:, mine] = np.stack([m.logs(fresh[mine]) for m in shared.value])
                            order = np.argsort(np.concatenate([seen, fresh]), kind="stable")
                            seen, logs = np.concatenate([seen, fresh])[order], np.concatenate([logs, more], axis=1)[:, order]
                            place = np.searchsorted(seen, kinds)
                        sums = np.stack([np.add.reduceat(row[at].astype(np.float64), first[:-1]) for row in logs[:, place]])
                    part = batch.slice(i, j - i)
                    if s:
                        sums = sums + part.column(len(columns)).flatten().to_numpy().reshape(j - i, names).T
                    if s == shards - 1:
                        yield finish(part.select(columns), -sums / np.maximum(size, 1), size, letters)
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * names, pa.int32()), pa.array(np.ascontiguousarray(sums.T).ravel()))
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], lists], names=[*columns, "sums_"])

        if s < shards - 1:
            rows = stage_table(rows.mapInArrow(run, rows.schema), "lang-sums")
            shared.unpersist()
        else:
            rows = rows.mapInArrow(run, schema)
    return rows


def _sharpened(cross: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a sharpness is multiplied with before the softmax."""
    return -cross * np.minimum(np.sqrt(size), 64)


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 12)


@dataclass
class Calibration:
    """What is fitted on texts that the models have not seen."""

    sharpness: float
    bounds: np.ndarray  # (language, length class): cross-entropies above are rejected


def calibrate(docs: DataFrame, models: Models, text_col: str = "text", lang_col: str = "lang") -> Calibration:
    """The sharpness of GRID under which the true languages of ``docs``, which models have not seen, are most likely; and for
    each language and length class the cross-entropy that ACCEPTED of its texts do not pass. The driver gets a row for each
    sharpness and each bin of a histogram."""
    names = models.names

    def finish(part: pa.RecordBatch, cross: np.ndarray, size: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        place = {x: i for i, x in enumerate(names)}
        true = np.array([place.get(x, -1) for x in part.column(1).to_pylist()], np.int64)
        ok = (true >= 0) & (letters > 0)
        loss = np.zeros(len(GRID))
        bins, counts = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if ok.any():
            z = _sharpened(cross, size)[:, ok]
            z = z - z[true[ok], np.arange(z.shape[1])]
            top = z.max(0)
            loss = np.array([(g * top + np.log(np.exp(g * (z - top)).sum(0))).sum() for g in GRID])
            own = cross[true[ok], np.flatnonzero(ok)]
            bins, counts = np.unique(np.stack([true[ok], _length_class(size[ok]), (own / BIN).astype(np.int64)], 1), axis=0, return_counts=True)
        lang = np.concatenate([np.full(len(GRID), -1), bins[:, 0]])
        at = np.concatenate([np.arange(len(GRID)), bins[:, 2]])
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(np.concatenate([np.zeros(len(GRID), np.int64), bins[:, 1]])), pa.array(at), pa.array(np.concatenate([loss, np.zeros(len(bins))])), pa.array(np.concatenate([np.full(len(GRID), ok.sum()), counts]))], names=["lang", "length", "at", "loss", "n"])

    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = _scored(source, models, finish, "lang long, length long, at long, loss double, n long").groupBy("lang", "length", "at").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    losses = [(r["loss"], r["at"]) for r in found if r["lang"] < 0 and r["n"]]
    bounds = np.full((len(names), 13), np.inf)
    bins: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in found:
        if r["lang"] >= 0:
            bins.setdefault((r["lang"], r["length"]), []).append((r["at"], r["n"]))
    for key, histogram in bins.items():
        histogram.sort()
        upto = np.cumsum([n for _, n in histogram])
        if upto[-1] >= ENOUGH:
            bounds[key] = (histogram[int(np.searchsorted(upto, ACCEPTED * upto[-1]))][0] + 2) * BIN
    return Calibration(float(GRID[min(losses)[1]]) if losses else SHARPNESS, bounds)


def sharpness_of(docs: DataFrame, models: Models, text_col: str = "text", lang_col: str = "lang") -> float:
    """The sharpness of ``calibrate``."""
    return calibrate(docs, models, text_col, lang_col).sharpness


def predict(docs: DataFrame, models: Models, least: float = 0.0, calibration: Calibration | None = None, reject: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row: the language of the lowest cross-entropy per character of the whole text.

    score is a softmax of minus the cross-entropies times the sharpness times the root of the number of characters, 64 at
    most, so that short texts are less sure. A prediction is rejected if its score is below ``least`` or its cross-entropy
    above the calibrated bound of its language and length, as it is in a language that no model knows; with ``reject`` its
    lang_pred is ``und``. So it is, with score 0, for null texts, texts without a letter, and all texts if there is no model;
    those are not called rejected. Ties go to the first name.
    """
    names = models.names
    calibration = calibration or Calibration(SHARPNESS, np.full((len(names), 13), np.inf))

    def finish(part: pa.RecordBatch, cross: np.ndarray, size: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        pred, score, out = np.full(part.num_rows, "und", object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
        if names:
            z = _sharpened(cross, size) * calibration.sharpness
            z = np.exp(z - z.max(0))
            z /= z.sum(0)
            best, every = np.argmin(cross, axis=0), np.arange(part.num_rows)
            sure = z[best, every]
            some = letters > 0
            out = some & ((sure < least) | (cross[best, every] > calibration.bounds[best, _length_class(size)]))
            told = some & ~out if reject else some
            pred[told] = np.array(names, object)[best[told]]
            score[some] = sure[some]
        return pa.RecordBatch.from_arrays([part.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(out)], names=["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    return _scored(source, models, finish, "id long, lang_pred string, score double, rejected boolean").select(F.col("id").alias(id_col), "lang_pred", "score", "rejected")


def languages(docs: DataFrame, held: Column, model_grams: int = MODEL_GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: models are fitted on documents outside ``held`` and applied to all.

    A rejected document keeps its lang_pred, the least bad of the learned languages. Null ids are in no fold and are not learned from. Rows that repeat are learned and predicted each. One of CALIBRATION
    folds of the learnable documents is counted apart: models of the others set the score's sharpness and the
    bounds of rejection on it, and the models that are applied are of all.
    """
    from pyspark.sql.functions import coalesce, lit

    from .labelled import fold
    from .tables import stage_table

    known = docs.where(~held & F.col("doc_id").isNotNull())
    apart = fold(F.col("doc_id"), CALIBRATION) == 0
    rest, part = (stage_table(count_grams(known.where(x)), "lang-grams") for x in (~apart, apart))
    calibration = calibrate(known.where(apart), models_of(rest, model_grams))
    both = stage_table(rest.union(part).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    out = predict(docs, models_of(both, model_grams), calibration=calibration, reject=False)
    return out.select("doc_id", coalesce(held, lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
