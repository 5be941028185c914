"""Near-duplicate documents by min-max hashing.

Every hash function is evaluated once over a document's shingles and both its minimum and its maximum are kept, so
64 evaluations give a signature of 128 values; each has the Jaccard similarity as its chance of agreeing. The signature
is cut into bands, documents that agree on a band are candidates, and candidates are confirmed on their full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, chunks, mix, shingles
from .graph import components
from .tables import drop_staged, stage_table

#: 32 bands of 4 values: at a similarity of 0.75 a pair of large sets misses all bands with a chance of 5e-6, above it with less.
BANDS, ROWS = 32, 4


def _signatures(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) band keys of documents whose shingle sets are not empty."""
    hashes = bands * rows // 2
    rng = np.random.default_rng(20)
    mult = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    low, high = (np.empty((hashes, len(first) - 1), np.uint64) for _ in "lh")
    at = first[:-1]
    for i in range(hashes):
        v = sets * mult[i] + add[i]
        low[i] = np.minimum.reduceat(v, at)
        high[i] = np.maximum.reduceat(v, at)
    # no band holds both ends of one function, which are not independent in small sets
    values = np.concatenate([low, np.roll(high, hashes // 4, axis=0)]).reshape(rows, bands, -1)
    key = np.arange(bands, dtype=np.uint64)[:, None] + np.zeros(values.shape[2], np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + values[r])
    return key.T


def features(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, c1 and c2 (128-bit digest of the shingle set), bands (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1), lower=True):
                sets, first = shingles(Words(buf, off), k)
                n = np.diff(first)
                some = n > 0
                keys = np.zeros((j - i, bands), np.uint64)
                c1, c2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if some.any():
                    at = first[:-1][some]
                    keys[some] = _signatures(sets, np.append(at, first[-1]), bands, rows)
                    c1[some], c2[some] = np.add.reduceat(mix(sets), at), np.add.reduceat(mix(sets ^ np.uint64(0xA5A5)), at)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * bands, pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], names=["id", "n", "c1", "c2", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, c1 long, c2 long, bands array<long>")


def _compare(pairs: DataFrame, texts: DataFrame, k: int, rest: bool = False) -> DataFrame:
    """(a, b, shared, n_a, n_b) with the exact intersection and sizes of the shingle sets of pairs of documents; with
    ``rest`` also the shingles of b that a lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets_of(ids: list[int], column: pa.Array) -> list[np.ndarray]:
            new = [i for i, x in enumerate(ids) if x not in kept and (i == 0 or ids[i - 1] != x)]  # a run of one id is read once
            fresh: dict[int, np.ndarray] = {}
            if new:
                for i, j, buf, off in chunks(column.take(pa.array(new)), lower=True):
                    s, first = shingles(Words(buf, off), k)
                    for x in range(i, j):
                        fresh[ids[new[x]]] = s[first[x - i] : first[x - i + 1]]
            out = [fresh[x] if x in fresh else kept[x] for x in ids]
            kept.update(fresh)
            while len(kept) > 64:
                kept.popitem(last=False)
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                sa = sets_of(a, part.column(2))
                sb = sets_of(b, part.column(3))
                shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sa, sb, strict=True)]
                cols = [part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array([len(x) for x in sa], pa.int64()), pa.array([len(x) for x in sb], pa.int64())]
                names = ["a", "b", "shared", "n_a", "n_b"]
                if rest:
                    cols.append(pa.array([np.setdiff1d(y, x, assume_unique=True).view(np.int64) for x, y in zip(sa, sb, strict=True)], pa.list_(pa.int64())))
                    names.append("rest")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long" + ", rest array<long>" * rest)


#: A shingle that more members of a leader's buckets have counts as common.
COMMON = 32


def _across(members: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the pairs of bucket members in different components that may still be linked.

    Members of a leader's buckets are described against what is common there: the leader's shingles and those of more than
    COMMON members. Two sets share at most the smaller of their common parts and the rare shingles that both hold, so pairs
    come from an equality of rare shingles, which few members have, or else both common parts alone must suffice, which
    bounds the other set's size. Pairs inside the component of most members need no look.
    """
    heads = members.where("rep <> leader").select("leader", "rep").distinct()
    against = stage_table(_compare(heads.select(F.col("leader").alias("a"), F.col("rep").alias("b")), texts, k, rest=True), "minhash-against")
    comp = found.select(F.col("node").alias("rep"), "component")
    heads = against.select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.col("n_b").alias("n"), "shared").dropDuplicates(["leader", "rep"])
    heads = heads.join(comp, "rep", "left").select("leader", "rep", "n", "shared", F.coalesce("component", "rep").alias("comp"))
    sizes = heads.groupBy("leader", "comp").agg(F.count("*").alias("m"))
    most = sizes.groupBy("leader").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("leader", "most")
    heads = heads.join(most, "leader").withColumn("outside", F.col("comp") != F.col("most"))

    held = against.select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.explode("rest").alias("h")).distinct().join(most.select("leader"), "leader", "left_semi")
    df = held.groupBy("leader", "h").agg(F.count("*").alias("df"))
    common = held.join(df.where(F.col("df") > COMMON).select("leader", "h"), ["leader", "h"], "left_semi").groupBy("leader", "rep").agg(F.count("*").alias("more"))
    heads = heads.join(common, ["leader", "rep"], "left").withColumn("own", F.col("shared") + F.coalesce("more", F.lit(0)))
    heads = stage_table(heads.select("leader", "rep", "n", "own", "comp", "outside"), "minhash-heads")

    rare = held.join(df.where((F.col("df") > 1) & (F.col("df") <= COMMON)).select("leader", "h"), ["leader", "h"], "left_semi")
    rare = rare.join(heads, ["leader", "rep"])
    x, y = (rare.select("leader", "h", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "own", "comp", "outside")]) for s in "xy")
    both = y.where("outside_y").join(x, ["leader", "h"]).where("comp_x <> comp_y and (not outside_x or rep_x < rep_y)")
    both = both.groupBy("leader", "rep_x", "rep_y", "n_x", "n_y", "own_x", "own_y").agg(F.count("*").alias("rare"))
    enough = lambda shared: f"{100 + percent} * ({shared}) >= {percent} * (n_x + n_y)"
    by_rare = both.where(enough("rare + least(own_x, own_y)")).select("rep_x", "rep_y")

    x, y = (heads.select("leader", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "own", "comp", "outside")]) for s in "xy")
    least, top = F.ceil(F.col("n_y") * percent / 100), F.floor(F.col("own_y") * (100 + percent) / percent) - F.col("n_y")
    y = y.where("outside_y").withColumn("least", least.cast("long")).withColumn("top", top.cast("long")).where("least <= top")
    y = y.withColumn("n_x", F.explode(F.sequence("least", "top")))
    by_common = y.join(x, ["leader", "n_x"]).where(f"comp_x <> comp_y and (not outside_x or rep_x <> rep_y) and {enough('least(own_x, own_y)')}").select("rep_x", "rep_y")
    pairs = by_rare.union(by_common)
    return pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A text is lower-cased (A-Z) and cut into words at ASCII white space; its set is its distinct k-word shingles, or the
    whole sequence if it has fewer words. Documents whose sets have 100 * intersection >= percent * union are linked;
    component_id is the smallest id reachable, kept says whether that is the document's own.

    Null or wordless texts have an empty set and link with nothing. A null id links with nothing, has a null
    component_id and is kept. Rows that share an id count as one document in links; each row is returned. Only the id and
    text columns are read, so others may have any name. An empty table gives an empty result.

    Documents with equal sets form a class first, so copies are never paired. In a bucket (class representatives that
    agree on a band) every member is checked against the smallest one, and where members are still in different components,
    against a random one; then the pairs across components that a bound on their shared shingles does not exclude are
    checked too (``_across``). So no bucket's pairs are all emitted, and no candidate link is lost.
    """
    feats = stage_table(features(docs, k, bands, rows, id_col, text_col), "minhash-features")
    classes = feats.where("n > 0 and id is not null").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = stage_table(classes, "minhash-classes")

    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("n_leader"), F.max("rep").alias("last"))
    members = stage_table(keyed.join(leaders.where("leader < last").select("key", "leader", "n_leader"), "key"), "minhash-members")
    near = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    first = members.where("rep <> leader").where(near("n", "n_leader"))
    first = stage_table(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-pairs")

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = stage_table(texts.join(wanted, "id", "left_semi"), "minhash-texts")
    linked = f"100 * shared >= {percent} * (n_a + n_b - shared)"
    links = stage_table(_compare(first, texts, k).where(linked).select("a", "b"), "minhash-links")
    found = components(links)

    def split(found: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components; a bucket of two has had its only pair checked."""
        placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "leader", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.min_by(F.struct("rep", "comp", "n"), F.xxhash64("rep", "key")).alias("pivot"))
        return placed.join(several.where("lo < hi and m > 2").select("key", "pivot"), "key")

    # The smallest member may be an odd one: a random one of each bucket that is still split is tried as well.
    tried = split(found).where(f"comp <> pivot.comp and rep <> leader and pivot.rep <> leader and {near('n', 'pivot.n')}")
    tried = tried.select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b")).distinct()
    more = stage_table(_compare(stage_table(tried, "minhash-tried"), texts, k).where(linked).select("a", "b"), "minhash-links")
    if more.limit(1).count():
        links = links.union(more)
        found = components(links)

    rest = stage_table(_across(split(found), found, texts, k, percent), "minhash-rest")
    more = stage_table(_compare(rest, texts, k).where(linked).select("a", "b"), "minhash-links")
    whole = components(links.union(more)) if more.limit(1).count() else found
    drop_staged(members, first, texts, rest)

    # Back from representatives to documents: a class may be as large as the input, so its rows are joined, not gathered.
    placed = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("component"))
    rows_ = feats.select("id", "n", "c1", "c2")
    out = rows_.join(placed, ["c1", "c2", "n"], "left")
    own = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
