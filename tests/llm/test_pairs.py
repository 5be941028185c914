"""Operations on repeats, against plain brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import SF_DIR

from keyloom.llm import decontam, embed, graph, lines, minhash, substring
from keyloom.llm.arrow_text import Words, chunks, shingles


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Links:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def similar(a, b):
    shared = len(a & b)
    return bool(a and b) and 100 * shared >= 75 * (len(a) + len(b) - shared)


def brute_near(rows):
    links = Links()
    data = [(i, sets(t)) for i, t in rows]
    for n, (i, a) in enumerate(data):
        for j, b in data[:n]:
            if i is not None and j is not None and similar(a, b):
                links.link(i, j)
    return sorted(((i, len(a), None if i is None else links.find(i), i is None or links.find(i) == i) for i, a in data), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates(docs, texts, nothing):
    assert got(minhash.near_duplicates(docs)) == brute_near(texts)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """A crowd of near copies of which many are just too far from the first: no link may be lost, nor one made."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3, 4])):
            words[rnd.randrange(60)] = f"e{rnd.randrange(40)}"
        if i % 9 == 0:
            words = words[: rnd.randrange(42, 60)]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame)) == brute_near(rows)


def test_signature_values_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 800, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 200, dtype=np.uint64)])  # 600 of 1000
    keys = minhash._signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 800, 1600]), 512, 1)
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40, 60)] + [(7, 3), (3, 9), (5, 5), (60, 40), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 40 for i in range(40, 61)}, 7: 3, 3: 3, 9: 3, 5: 5}


def brute_repeats(rows, size=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        for p in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[p : p + size])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1) if i is not None else ():
            if low[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(docs, texts, nothing):
    assert got(substring.remove_repeats(docs)) == brute_repeats(texts)
    assert substring.remove_repeats(nothing).count() == 0


def test_repeats_of_random_words(spark):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice("ab") for _ in range(14)) for _ in range(6)]
    rows = [(i, " ".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice("abc ") for _ in range(8))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(substring.remove_repeats(frame)) == brute_repeats(rows)
    kept = substring.remove_repeats(frame, with_text=True).select("kept_sha256", "kept_text").collect()
    assert all(hashlib.sha256(r[1].encode()).hexdigest() == r[0] for r in kept)


def test_equal_windows_are_filed_alike():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    joined = np.concatenate([words, words[50:200], words[10:40]])
    row, window, filed = substring.file_windows(joined, np.array([0, 400, 550, 580]), 13)
    seen = {}
    assert all(seen.setdefault(w, f) == f for w, f in zip(window.tolist(), filed.tolist(), strict=True)) and len(seen) < len(window)


def brute_leaks(rows, items, k=5):
    from collections import Counter

    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        for item, text in items:
            q = (text or "").encode().lower().split()
            n, kk = len(q), min(k, len(q))
            if not n or item is None:
                continue
            target = Counter(tuple(q[p : p + kk]) for p in range(n - kk + 1))
            best = None
            for s in range(len(w) - n + 1):
                c = Counter(tuple(w[s + p : s + p + kk]) for p in range(n - kk + 1))
                shared, total = sum((c & target).values()), sum((c | target).values())
                if 100 * shared >= 75 * total and (best is None or shared > best[2]):
                    best = (s, n, shared, total)
            if best:
                out.append((i, item, *best))
    return sorted(out, key=repr)


def test_leaks(spark, docs, texts, nothing):
    from llm_data import prose

    w = prose(5, 60).split()
    items = [(1, " ".join(w[5:45])), (2, " ".join(w[10:30] + ["odd"] + w[31:50])), (3, prose(77, 20)), (4, "one two three"), (5, None), (6, ""), (7, " ".join(w[:20] + ["p", "q"] + w[22:30] + ["r"] + w[31:40])), (None, "one two three"), (8, "no no no no no no no")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        assert got(decontam.find_leaks(docs, bench, block_items=block).drop("similarity")) == brute_leaks(texts, items)
    clean = decontam.drop_leaks(docs, bench)
    bad = {i for i, *_ in brute_leaks(texts, items)}
    assert clean.columns == docs.columns and clean.count() == sum(i not in bad for i, _ in texts)
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(docs, bench.where("1 = 0")).count() == 0


def brute_whole_leaks(rows, items, k=5):
    """As brute_leaks, and a text of k or more words that is shorter than the item is one window."""
    from collections import Counter

    out = brute_leaks(rows, items, k)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        for item, text in items:
            q = (text or "").encode().lower().split()
            if item is None or not k <= len(w) < len(q):
                continue
            c, target = (Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1)) for x in (w, q))
            shared, total = sum((c & target).values()), sum((c | target).values())
            if 100 * shared >= 75 * total:
                out.append((i, item, 0, len(w), shared, total))
    return sorted(out, key=repr)


def test_leaks_in_texts_shorter_than_the_item(spark):
    from llm_data import prose

    w = prose(5, 40).split()
    texts = [w[:39], w[1:], w[1:39], w[3:36], w[:31], w[:32], w[:12] + ["odd"] + w[13:38], w[:4], w, prose(6, 30).split(), prose(8, 20).split() + w[:39], w[5:13], w[5:11], w[5:12], w[5:9]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(w[:39])), (90, None), (91, "")]
    items = [(1, " ".join(w)), (2, " ".join(w[5:13])), (3, " ".join(w[:3])), (4, " ".join(w[:38])), (5, None), (6, prose(77, 20)), (7, " ".join(["la lu"] * 10))]
    rows.append((92, " ".join(["la lu"] * 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_whole_leaks(rows, items)
    assert (0, 1, 0, 39, 35, 36) in want and len(want) > len(brute_leaks(rows, items))
    for block in (20_000, 2):
        assert got(decontam.find_leaks(docs, bench, block_items=block).drop("similarity")) == want
    bad = {i for i, *_ in want}
    assert sorted(repr(r[0]) for r in decontam.drop_leaks(docs, bench).collect()) == sorted(repr(i) for i, _ in rows if i not in bad)


def indexed(rows, k=5):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["i", "t"])
    return decontam.index_items([tuple(r.values()) for b in decontam._features(iter([batch]), k) for r in b.to_pylist()], k)


def test_no_fingerprint_within_the_radius_is_missed():
    rng = np.random.default_rng(1)
    items = indexed([(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for i in range(50)])
    (kind,) = items.kinds
    for trial in range(300):
        bits = rng.choice(64, decontam.RADIUS, replace=False)
        print_ = kind.prints[trial % 50, :1] ^ np.uint64(sum(1 << int(b) for b in bits))
        row, item = kind.near(print_, np.ones(1, bool))
        assert trial % 50 in item.tolist()


def test_blocks_let_few_unrelated_items_pass():
    rng = np.random.default_rng(2)
    items = indexed([(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 40))) for i in range(2000)])
    (kind,) = items.kinds
    other = indexed([(i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 40))) for i in range(200)]).kinds[0].prints[:, 0].copy()
    row, _ = kind.near(other, np.ones(200, bool), cut=64)
    assert len(row) / (200 * 2000) < 0.01


def changed(rnd, words, edits):
    """Words with some replaced, left out or put in, and perhaps cut at an end."""
    w = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(w))
        kind = rnd.randrange(3)
        w[at : at + (kind < 2)] = ["other"] * (kind > 0)
    return w[rnd.randrange(3) :] if rnd.random() < 0.5 else w


def test_recall_against_brute_force(spark):
    """Passages that differ from items so much that many are just similar enough: nearly all of these are found, and no other."""
    from llm_data import prose

    rnd = random.Random(6)
    items = [(i, prose(1000 + i, rnd.randrange(15, 150))) for i in range(120)]
    rows = []
    for i in range(600):
        n, text = items[i % 120]
        part = changed(rnd, text.split(), rnd.randrange(0, 4) if len(text.split()) > 60 else rnd.randrange(0, 2))
        rows.append((i, prose(3000 + i, rnd.randrange(0, 60)) + " " + " ".join(part) + " " + prose(5000 + i, rnd.randrange(0, 60))))
    mine = [[(j, t) for j, t in items if sets(t) & sets(x)] for _, x in rows]  # an item without a common shingle has a similarity of 0
    want = {tuple(x) for r, m in zip(rows, mine, strict=True) for x in brute_leaks([r], m)}
    found = set(got(decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).drop("similarity")))
    assert found <= want and len(want) > 300
    tight = {r for r in want if 100 * r[4] < 85 * r[5]}
    assert len(tight) > 60 and len(found & tight) >= 0.9 * len(tight) and len(found) >= 0.97 * len(want)


def test_many_items_with_a_shared_beginning_take_little_time_and_memory():
    import time
    import tracemalloc

    import pyarrow as pa
    from llm_data import prose

    head = prose(1, 8)
    items = indexed([(i, head + " " + prose(100 + i, 30)) for i in range(2000)])
    texts = pa.array([" ".join([head] * 450)])
    tracemalloc.start()
    began = time.time()
    assert list(decontam.scan(items, texts, 75)) == []
    assert time.time() - began < 5 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_long_items_and_long_texts(spark):
    from llm_data import prose

    long = prose(50, 900).split()
    rows = [(1, " ".join(prose(51, 3000).split() + long + prose(52, 50).split())), (2, " ".join(long[:800])), (3, " ".join(long[:500])), (4, "no " * 5000)]
    items = [(1, " ".join(long)), (2, "no " * 40)]
    assert got(decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("similarity")) == brute_whole_leaks(rows, items)


def test_lines(spark, duck, docs, nothing):
    from collections import defaultdict

    rows = [(i, "\n".join(["all rights reserved", f"own {i}", "", "few"][: 2 + i % 3] + (["twice", "twice"] if i % 2 else [])), f"s{i % 12}") for i in range(40)] + [(100, None, "s1"), (101, "", None), (102, "all rights reserved\nx", None), (None, "all rights reserved", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sites = defaultdict(set)
    first = {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n")) if t is not None and i is not None else ():
            if line.strip():
                if s is not None:
                    sites[line].add(s)
                first[line] = min(first.get(line, (i, p)), (i, p))
    want = {}
    for i, t, _ in rows:
        if t is not None and i is not None:
            want[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if not (len(sites[x]) >= 5 and first[x] != (i, p)))
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(frame).collect()}
    assert out == want | {100: None, None: "all rights reserved"}
    assert lines.line_dedup(docs).columns == docs.columns and lines.line_dedup(docs).count() == docs.count()
    assert lines.line_dedup(nothing).count() == 0 and lines.line_report(nothing).count() == 0


def test_joins_with_frequent_keys(spark, monkeypatch):
    """Keys of many rows are dealt over several tasks; the rows are those of a plain join."""
    from pyspark.sql import functions as F

    from keyloom.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 7)
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b" if i % 3 else f"k{i}") for i in range(200)] + [(500, None)], "id long, key string")
    few = rows.where("key is not null and key <> 'k6'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    out = tables.join_frequent(rows, few, ["key"], "id")
    assert out.columns == ["key", "id", "lo"] and got(out) == got(rows.join(few.drop("n"), "key"))
    assert "salt_" in out._jdf.queryExecution().analyzed().toString()
    text = "\n".join(["all rights reserved", "own"])
    docs = spark.createDataFrame([(i, text.replace("own", f"own {i}"), f"s{i % 12}") for i in range(60)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()} == {i: f"own {i}" if i else text.replace("own", "own 0") for i in range(60)}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [(c * 50 + i, (centre + rng.normal(size=8) * rng.choice([0.02, 0.08, 0.2])).tolist(), c % 2) for i in range(40)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [2 * x for x in rows[0][1]], 0), (1003, rows[0][1], None), (1004, [0.0] * 8, 0), (1005, None, 0), (1006, [float("nan")] + [1.0] * 7, 0), (1007, [None] + [1.0] * 7, 0), (1008, rows[0][1][:5], 0), (1009, [], 0), (None, rows[0][1], 0), (1010, [float("inf")] + [1.0] * 7, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)

    def live(r):
        return None not in (r[0], r[1], r[2]) and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links, count = Links(), {}
    for a in filter(live, rows):
        for b in filter(live, rows):
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.link(a[0], b[0])
                    count[a[0]] = count.get(a[0], 0) + 1
    want = sorted(((r[0], count.get(r[0], 0), None if r[0] is None else links.find(r[0]), r[0] is None or links.find(r[0]) == r[0]) for r in rows), key=repr)
    assert got(embed.near_vectors(frame)) == want
    assert embed.near_vectors(frame.where("1 = 0")).count() == 0


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Ab  c\td a B C D", "", None, "x", "éa b c\x0bd  ", "\x1ca\x85b c"]
    for i, j, buf, off in chunks(pa.array(texts), lower=True):
        w = Words(buf, off)
        for n in range(i, j):
            raw = (texts[n] or "").encode().lower().split()
            assert [bytes(buf[a:b]) for a, b in zip(w.starts[w.first[n] : w.first[n + 1]], w.ends[w.first[n] : w.first[n + 1]], strict=True)] == raw
        s, first = shingles(w, 5)
        assert np.diff(first).tolist() == [len(sets(t)) for t in texts]


@pytest.mark.parametrize("name", ["op7_recompression_repeats", "op8_pstable_vectors", "op9_line_spread"])
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    from helpers import rows

    from keyloom.llm.queries import ORACLE_SQL, QUERIES

    want = duck.sql(ORACLE_SQL[name]).df()
    assert rows(QUERIES[name](spark, SF_DIR).toPandas(), sorted(want.columns)) == rows(want, sorted(want.columns))
