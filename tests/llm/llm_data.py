"""What several test modules share."""

from collections import Counter

WORDS = "ab cde fgh ijkl mn opq rstu vw xyz la lu lo ra ru ro ka ku ko ta tu".split()


def prose(seed: int, n: int) -> str:
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def brute_leak_ids(docs, benchmark, k=5):
    items = [r["text"].encode().lower().split() for r in benchmark.collect()]
    grams = [Counter(tuple(q[p : p + k]) for p in range(len(q) - k + 1)) for q in items]
    known = {g for c in grams for g in c}
    out = set()
    for r in docs.collect():
        w = r["text"].encode().lower().split()
        at = [p for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in known]
        for q, target in zip(items, grams, strict=True):
            n = len(q)
            for s in sorted({p - d for p in at for d in range(n - k + 1) if tuple(w[p : p + k]) in target and 0 <= p - d <= len(w) - n}):
                c = Counter(tuple(w[s + p : s + p + k]) for p in range(n - k + 1))
                if 100 * sum((c & target).values()) >= 75 * sum((c | target).values()):
                    out.add(r["doc_id"])
    return out


def plain_network(net, text: bytes) -> float:
    """The network's probability for a text, block by block."""
    import numpy as np

    from keyloom.llm import quality

    blocks = max(1, -(-len(text) // 4))
    data = text.ljust(4 * (blocks + 1), b"\0")
    conv = [np.concatenate([net.p["emb"][c] for c in data[4 * i : 4 * i + 8]]) @ net.p["w"] for i in range(blocks)]
    tops = [np.max(conv[at : at + quality.HALF], axis=0) if at < blocks else np.full(quality.FILTERS, -1e9) for at in range(0, blocks + 1, quality.HALF)]
    chunks = [np.maximum(np.maximum(tops[i], tops[min(i + 1, len(tops) - 1)]) + net.p["c"], 0) for i in range(len(tops))]
    return float(1 / (1 + np.exp(-(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.p["v"] + net.p["b"][0]))))


def plain_lines(rows, least=5):
    """Texts by id without the lines on ``least`` sites or more, but for each one's first occurrence; rows are id, text, site."""
    sites, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            if i is not None and t is not None and line.strip(" \t\r\f\x0b"):
                sites.setdefault(line, set()).update([s] if s is not None else [])
                first[line] = min(first.get(line, (i, p)), (i, p))
    return {i: t if t is None or i is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not (len(sites.get(x, ())) >= least and first[x] != (i, p))) for i, t, _ in rows}
