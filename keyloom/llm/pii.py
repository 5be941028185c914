"""Personal data: spans of fixed patterns, and more spans from a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, so that a run of digits or letters is read once: a number that fails is not tried again from its second
#: digit on, and what stands before an at-sign is not tried again from its second letter on.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_RUN, _NEXT_RUN = re.compile(rf"{_LOCAL}++@"), re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@")
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
#: Weights are kept for hashed features.
FEATURES = 1 << 13
#: Words on each side of a digit or at-sign that are read with it.
CONTEXT = 4
#: Tokens, padding included, that are labelled in step.
CELLS = 1 << 14

Span = tuple[str, int, int]
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w")
_WORD = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@]|[(\[{<]\s?(?:at|AT|dot|DOT)\s?[)\]}>]|\b(?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT) ")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _part(digits: str) -> bool:
    """Whether a number, perhaps with leading zeros, is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    """Matches of local part, at-sign and host with a dot; after a match the next may begin inside a run of letters."""
    at = 0
    while m := _RUN.match(text, at) or _NEXT_RUN.search(text, at):
        host = _HOST.match(text, m.end())
        at = m.end()
        if host:
            at = host.end()
            yield "email", m.start(), at


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern, less those that fail its test; by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in PATTERNS["ip"].finditer(text) if all(_part(p) for p in m.group().split("."))]
    for m in PATTERNS["card"].finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PATTERNS["phone"].finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def labelled_table(rows: int = 320, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Short texts with marked spans, made from patterns of how people write such data, and of numbers that are none."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(["an", "ter", "lo", "mi", "sche", "que", "ing", "do", "ra", "les", "er", "th"]) for _ in range(rnd.randrange(1, 4)))
    host = lambda: word() + rnd.choice(["", d(1)])
    end = lambda: rnd.choice(["com", "org", "net", "de", "fr", "es", "info"])
    made = {
        "email": [lambda: f"{word()}.{d(2)}@{host()}.{end()}", lambda: f"{word()} at {host()} dot {end()}", lambda: f"{word()} (at) {host()} (dot) {end()}", lambda: f"{word()}[at]{host()}.{end()}", lambda: f"{word()} [at] {host()} [dot] {end()}", lambda: f"{word()} @ {host()} . {end()}"],
        "ip": [lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: " . ".join(str(rnd.randrange(256)) for _ in range(4)), lambda: "[.]".join(str(rnd.randrange(256)) for _ in range(4))],
        "card": [lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)} {d(6)} {d(5)}", lambda: d(15), lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"],
        "phone": [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(6)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}"],
    }
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    none = [
        lambda: f"{rnd.randrange(1900, 2100)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{rnd.randrange(1900, 2100)}", lambda: f"{d(2)}:{d(2)}", lambda: f"version {d(1)}.{d(1)}.", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"${d(2)},{d(3)}.{d(2)}",
        lambda: d(rnd.randrange(1, 6)), lambda: f'token = "{hexa(40)}"', lambda: f"{word()}{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(3)} {d(3)}", lambda: f"{word()} at {word()} {word()}", lambda: f"@{word()}", lambda: hexa(12), lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{d(24)}", lambda: f"{word()} {word()}.", lambda: f"{d(2)}%", lambda: f"({d(1)})",
    ]
    out = []
    for i in range(rows):
        kind = (*KINDS, None)[i % 5]
        body = (made[kind][(i // 5) % len(made[kind])] if kind else none[(i // 5) % len(none)])()
        left = " ".join(word() for _ in range(rnd.randrange(0, 4)))
        left = f"{left}{rnd.choice([' ', ' ', '. ', ': ', ', '])}" if left else ""
        right = rnd.choice(["", " ", ", ", ". "]) + " ".join(word() for _ in range(rnd.randrange(0, 4)))
        right = right if not right or not right[0].isalnum() else " " + right
        out.append((left + body + right, [(kind, len(left), len(left) + len(body))] if kind else []))
    return out


def _shape(t: str) -> str:
    c = t[0]
    if "0" <= c <= "9":
        n = len(t)
        return f"d{n}" if n <= 4 else "d5-6" if n <= 6 else "d7-8" if n <= 8 else "d9-12" if n <= 12 else "d13-19" if n <= 19 else "d20+"
    if c.isalpha():
        return "w1" if len(t) == 1 else "low" if t.islower() else "up" if t.isupper() else "cap"
    return t


_NAMED = {"at", "dot", "com", "org", "net", "info", "version", "tel", "phone", "call", "card", "mail", "email", "ip"}


def _features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """(tokens, n) hashed features: shapes of a token and its neighbours, gaps, and a few words by name."""
    shapes = [_shape(text[a:b]) for a, b in tokens]
    gap = [0] + [min(2, tokens[i][0] - tokens[i - 1][1]) for i in range(1, len(tokens))] + [0]
    pad = ["<", "<", "<", *shapes, ">", ">", ">"]
    rows = np.zeros((len(tokens), 12), np.int16)
    for i, (a, b) in enumerate(tokens):
        s, p, q, n, m = pad[i + 3], pad[i + 2], pad[i + 1], pad[i + 4], pad[i + 5]
        w = text[a:b].lower()
        w = w if w in _NAMED else "*"
        small = "s" if s[0] == "d" and b - a <= 3 and int(text[a:b]) <= 255 else "-"
        g, h = gap[i], gap[i + 1]
        f = [s, f"p{p}|{s}", f"n{s}|{n}", f"q{q}|{p}|{s}", f"m{s}|{n}|{m}", f"r{pad[i]}|{q}|{p}|{s}", f"o{s}|{n}|{m}|{pad[i + 6]}", f"g{g}|{p}|{s}", f"h{h}|{s}|{n}", f"w{w}", f"c{small}|{g}|{h}", f"x{q}|{p}|{s}|{n}|{m}"]
        rows[i] = [zlib.crc32(x.encode()) % FEATURES for x in f]
    return rows


@dataclass
class Field:
    """Weights of features by label, and of label pairs."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi over all sequences of a batch in step."""
        return self.paths([self.scores(f) for f in feats])

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """(tokens, labels) sums of weights, a part of a long sequence at a time."""
        return np.concatenate([self.emit[feats[i : i + CELLS]].sum(axis=1) for i in range(0, max(1, len(feats)), CELLS)])

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of scores. Sequences of similar length share a batch of CELLS tokens, padding
        included, or one sequence."""
        lens = np.array([len(e) for e in scores], np.int64)
        out: list[np.ndarray] = [np.zeros(n, np.int64) for n in lens]
        order = np.argsort(-lens, kind="stable")[: int((lens > 0).sum())]
        at = 0
        while at < len(order):
            top = int(lens[order[at]])
            rows = order[at : at + max(1, CELLS // top)]
            at += len(rows)
            n, every = lens[rows], np.arange(len(rows))
            e = np.zeros((top, len(rows), len(LABELS)))
            for k, i in enumerate(rows):
                e[: lens[i], k] = scores[i]
            best, back = e[0] + _START, np.zeros((top, len(rows), len(LABELS)), np.int8)
            last = best.copy()
            live = len(rows)  # rows are sorted: the first ones go on
            for t in range(1, top):
                while n[live - 1] <= t:
                    live -= 1
                step = best[:live, :, None] + self.move
                back[t, :live] = step.argmax(axis=1)
                best = step.max(axis=1) + e[t, :live]
                last[:live] = best
            y = last.argmax(axis=1)
            path = np.zeros((top, len(rows)), np.int8)
            for t in range(top - 1, -1, -1):
                path[t] = y
                y = np.where(t < n, back[t, every, y], y)
            for k, i in enumerate(rows):
                out[i][:] = path[: lens[i], k]
        return out


_START = np.array([0.0 if x[0] != "I" else -1e4 for x in LABELS])
_ALLOWED = np.array([[b[0] != "I" or a[1:] == b[1:] and a != "O" for b in LABELS] for a in LABELS])


def _tokens(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, len(text) if hi is None else hi)]


def train(table: list[tuple[str, list[Span]]], rounds: int = 100, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Weights of the greatest penalised likelihood, by Adam on exact gradients from forward and backward sums."""
    feats, gold = [], []
    for text, spans in table:
        tokens = _tokens(text)
        y = np.zeros(len(tokens), np.int64)
        for kind, a, b in spans:
            inside = [i for i, (s, e) in enumerate(tokens) if a <= s and e <= b]
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[:1]] = LABELS.index(f"B-{kind}")
        if tokens:
            feats.append(_features(text, tokens)), gold.append(y)
    n, top, k = len(feats), max(len(f) for f in feats), len(LABELS)
    lens = np.array([len(f) for f in feats])
    x = np.zeros((n, top, 12), np.int64)
    y = np.zeros((n, top), np.int64)
    mask = np.arange(top) < lens[:, None]
    for i, (f, g) in enumerate(zip(feats, gold, strict=True)):
        x[i, : len(f)], y[i, : len(g)] = f, g
    ban = np.where(_ALLOWED, 0, -1e4)
    p = {"emit": np.zeros((FEATURES, k)), "move": np.zeros((k, k))}
    m, v = ({a: np.zeros_like(b) for a, b in p.items()} for _ in "mv")
    lse = lambda a, axis: (t := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - t).sum(axis=axis))
    onehot = np.eye(k)[y] * mask[:, :, None]
    pair_mask = (mask[:, 1:] & mask[:, :-1])[:, :, None, None]
    gold_pairs = (np.eye(k)[y[:, :-1]][:, :, :, None] * np.eye(k)[y[:, 1:]][:, :, None, :] * pair_mask).sum((0, 1))
    for r in range(1, rounds + 1):
        e = p["emit"][x].sum(axis=2)
        move = p["move"] + ban
        a, b = np.zeros((n, top, k)), np.zeros((n, top, k))
        a[:, 0] = e[:, 0] + _START
        for t in range(1, top):
            step = lse(a[:, t - 1, :, None] + move, 1) + e[:, t]
            a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
        z = lse(a[:, -1], 1)
        for t in range(top - 2, -1, -1):
            step = lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None], step, b[:, t + 1])
        prob = np.exp(np.minimum(a + b - z[:, None, None], 0)) * mask[:, :, None]
        pairs = np.exp(np.minimum(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None], 0)) * pair_mask
        grads = {"emit": np.zeros_like(p["emit"]), "move": pairs.sum((0, 1)) - gold_pairs}
        flat = (prob - onehot).reshape(-1, k)
        for c in range(k):
            grads["emit"][:, c] = np.bincount(x.reshape(-1), np.repeat(flat[:, c], 12), FEATURES)
        for name, g in grads.items():
            g = g + decay * n * p[name] / 10
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            p[name] = p[name] - rate * (m[name] / (1 - 0.9**r)) / (np.sqrt(v[name] / (1 - 0.99**r)) + 1e-8)
    return Field(p["emit"], p["move"] + ban)


def _segments(text: str) -> list[list[tuple[int, int]]]:
    """Tokens of the stretches of text that hold a digit, an at-sign or a written-out one, with CONTEXT words on each side.

    A stretch is of whole words, however long, and those that touch are one; so no span is cut.
    """
    hints = [m.start() for m in _HINT.finditer(text)]
    if not hints:
        return []
    starts, ends = (np.array(x) for x in zip(*(m.span() for m in _WORD.finditer(text)), strict=True))
    word = np.unique(np.searchsorted(starts, hints, side="right") - 1)
    lo, hi = np.maximum(word - CONTEXT, 0), np.minimum(word + CONTEXT, len(starts) - 1)
    fresh = np.ones(len(word), bool)
    fresh[1:] = lo[1:] > hi[:-1] + 1
    at = np.flatnonzero(fresh)
    return [_tokens(text, int(starts[a]), int(ends[b])) for a, b in zip(lo[at], hi[np.append(at[1:], len(word)) - 1], strict=True)]


def _likely(kind: str, s: str) -> bool:
    """Whether a span of the field can be of its kind at all."""
    n = len(_digits(s))
    if kind == "email":
        return bool(re.search(r"@|\b(at|AT)\b", s)) and bool(re.search(r"\.|\b(dot|DOT)\b", s)) and s[0].isalnum()
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= n <= 19 if kind == "card" else 9 <= n <= 15


def find_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the field's spans are added where they overlap no base span."""
    base = [base_spans(t or "") for t in texts]
    where, scores, toks = [], [], []
    for i, t in enumerate(texts):
        for seg in _segments(t) if t else ():
            if seg:
                where.append(i), toks.append(seg), scores.append(field.scores(_features(t, seg)))
    every = [list(b) for b in base]
    for i, seg, labels in zip(where, toks, field.paths(scores), strict=True):
        j = 0
        while j < len(seg):
            name = LABELS[labels[j]]
            k = j + 1
            if name != "O":
                while k < len(seg) and LABELS[labels[k]] == f"I-{name[2:]}":
                    k += 1
                kind, a, b = name[2:], seg[j][0], seg[k - 1][1]
                if _likely(kind, texts[i][a:b]) and not any(s < b and a < e for _, s, e in every[i]):
                    every[i].append((kind, a, b))
            j = k
    rank = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(e, key=lambda s: (rank[s[0]], s[1]))) for b, e in zip(base, every, strict=True)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added (spans of the field).

    Spans are kind:start:end in code points, end exclusive, by kind as in KINDS and then start, joined by commas. A null or
    empty text has none. Only the id and text columns are read; rows that repeat, and null ids, are returned each.
    """
    field = field or train(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = find_spans(part.column(1).to_pylist(), shared.value)
                counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([_joined(e) for _, e in found], pa.string()), pa.array([len(e) - len(b) for b, e in found], pa.int64())], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    out = source.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)
