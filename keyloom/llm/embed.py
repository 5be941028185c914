"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix
from .graph import components
from .tables import stage_table

#: Tables, and projections of a table. A projection is cut in steps of STEP times the distance at the threshold, where it
#: agrees with a chance of 0.80; a pair at the threshold misses all tables with a chance of 8e-6, a closer one with less.
TABLES, PROJECTIONS, STEP = 64, 8, 4.0
#: Vectors of a component that are compared as one block.
BLOCK = 512


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (null ones NaN), offsets, and which lists are not null."""
    column = column.cast(pa.list_(pa.float64()))
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    return values, off, there


def _unit(values: np.ndarray, off: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    x = values[off[:-1][rows][:, None] + np.arange(dim)]
    top = np.abs(x).max(axis=1, keepdims=True)  # keeps squares from overflow and underflow
    x = x / np.where(np.isfinite(top) & (top > 0), top, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame, least: float, tables: int, projections: int) -> DataFrame:
    """id, label, c1 and c2 (128-bit digest of the components), keys (null for a vector that links with nothing)."""
    step = STEP * float(np.sqrt(2 - 2 * least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                values, off, there = _lists(part.column(1))
                label = part.column(2)
                known = there & ~label.is_null().to_numpy(zero_copy_only=False) & ~part.column(0).is_null().to_numpy(zero_copy_only=False)
                tags = label.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                dims = np.where(there, np.diff(off), 0)
                keys = np.zeros((n, tables), np.uint64)
                c1, c2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                good = np.zeros(n, bool)
                for dim in np.unique(dims[known]).tolist():
                    if dim == 0:
                        continue
                    rows = np.flatnonzero(known & (dims == dim))
                    raw = values[off[:-1][rows][:, None] + np.arange(dim)]
                    fine = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                    rows, raw = rows[fine], raw[fine] + 0.0
                    if not len(rows):
                        continue
                    good[rows] = True
                    if dim not in planes:
                        rng = np.random.default_rng(dim)
                        planes[dim] = rng.normal(size=(dim, tables * projections)), rng.uniform(0, 1, tables * projections)
                    cells = np.floor(_unit(values, off, rows, dim) @ planes[dim][0] / step + planes[dim][1]).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
                    key = mix(tags[rows] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(dim))[:, None] + np.arange(tables, dtype=np.uint64)
                    for r in range(projections):
                        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + cells[:, :, r])
                    keys[rows] = key
                    bits = raw.view(np.uint64)
                    h1, h2 = np.full(len(rows), dim, np.uint64), np.full(len(rows), dim + 7, np.uint64)
                    for r in range(dim):
                        h1 = mix(h1 * np.uint64(0x9DDFEA08EB382D69) + bits[:, r])
                        h2 = mix(h2 * np.uint64(0xC2B2AE3D27D4EB4F) + bits[:, r])
                    c1[rows], c2[rows] = h1, h2
                first = np.concatenate([[0], np.cumsum(good)]).astype(np.int32) * tables
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(keys[good].ravel().view(np.int64)), mask=pa.array(~good))
                yield pa.RecordBatch.from_arrays([part.column(0), label, pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], names=["id", "label", "c1", "c2", "keys"])

    return vectors.mapInArrow(run, "id long, label long, c1 long, c2 long, keys array<long>")


def _cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of nodes, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            (x, xo, _), (y, yo, _) = _lists(batch.column(2)), _lists(batch.column(3))
            dims = np.diff(xo)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for i in range(0, len(rows), 4096):
                    r = rows[i : i + 4096]
                    out[r] = (_unit(x, xo, r, dim) * _unit(y, yo, r, dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])

    right = nodes.select(F.col("rep").alias("b"), F.col("vector").alias("vb"), F.col("label").alias("lb"))
    left = nodes.select(F.col("rep").alias("a"), F.col("vector").alias("va"), F.col("label").alias("la"))
    both = pairs.join(right, "b").join(left, "a").where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb")
    return both.mapInArrow(run, "a long, b long, cosine double")


def _degrees(nodes: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """(rep, n): rows linked with each node's class, other than its own, counted over the node's component.

    A component is cut into blocks of about BLOCK nodes; a task compares two blocks as matrices, so a node travels once for
    each block of its component, not once for each link.
    """
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = nodes.join(comps, nodes.rep == comps.node).join(sizes, "component")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "m", "label", "vector")

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        mine = table["mine"].to_numpy()
        rep, m, label = (table[c].to_numpy() for c in ("rep", "m", "label"))
        values, off, _ = _lists(table["vector"].combine_chunks())
        dims = np.diff(off)
        n = np.zeros(len(rep), np.int64)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = _unit(values, off, rows, dim)
            a, b = np.flatnonzero(mine[rows] == i), np.flatnonzero(mine[rows] == j)
            for at in range(0, len(a), 1024):
                p = a[at : at + 1024]
                cosine = x[p] @ x[b].T
                for i_, j_ in zip(*np.nonzero(np.abs(cosine - least) < 1e-9), strict=True):  # sums as for the links themselves
                    cosine[i_, j_] = (x[p[i_]] * x[b[j_]]).sum()
                link = (cosine >= least) & (label[rows[p]][:, None] == label[rows[b]][None]) & (rep[rows[p]][:, None] != rep[rows[b]][None])
                n[rows[p]] += link @ m[rows[b]]
                if i != j:
                    n[rows[b]] += link.T @ m[rows[p]]
        return pa.table({"rep": rep, "n": n})

    return placed.groupBy("component", "i", "j").applyInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of equal label and length are linked if their cosine, in double precision, is ``least`` or more. n_links counts
    the other rows linked directly, component_id is the smallest id reachable, kept says whether it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a null id
    (component_id null, kept) or label. Rows that share an id count as one in components; each row is returned and counted.
    Only the three columns are read, so others may have any name. An empty table gives an empty result.

    Equal vectors form a class first. In a bucket every class is checked against the smallest; classes still in different
    components are then checked pair by pair, unless their angles to that smallest one exclude a link.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    rows = stage_table(hashed(source, least, tables, projections), "embed-rows")
    classes = rows.where("keys is not null").groupBy("label", "c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("keys").alias("keys"))
    classes = stage_table(classes, "embed-classes")
    raw = source.where("id is not null and vector is not null and label is not null").groupBy("id").agg(F.first("vector").alias("vector"))
    nodes = classes.groupBy("rep").agg(F.sum("m").alias("m"), F.first("label").alias("label"))
    nodes = stage_table(nodes.join(raw, nodes.rep == raw.id).select("rep", "m", "label", "vector"), "embed-nodes")

    keyed = classes.select("rep", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    members = stage_table(keyed.join(leaders, "key"), "embed-members")
    first = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    checked = stage_table(_cosines(first, nodes), "embed-checked")
    links = checked.where(F.col("cosine") >= least).select("a", "b")
    found = components(links)

    angle = checked.select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))).alias("t"))
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "leader", "rep", F.coalesce("component", "rep").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key")
    placed = stage_table(placed.join(split, "key").where("rep <> leader").join(angle, ["leader", "rep"], "left"), "embed-split")
    x, y = (placed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "t")]) for s in "xy")
    reach = float(np.arccos(least)) + 1e-9
    rest = x.join(y, "key").where(f"rep_x < rep_y and comp_x <> comp_y and coalesce(abs(t_x - t_y) <= {reach}, true)")
    more = stage_table(_cosines(rest.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct(), nodes).where(F.col("cosine") >= least).select("a", "b"), "embed-more")
    whole = components(links.union(more)) if more.limit(1).count() else found

    degrees = _degrees(nodes, whole, least)
    placed = classes.select("label", "c1", "c2", "rep", "m").join(whole.withColumnRenamed("node", "rep"), "rep", "left").join(degrees, "rep", "left")
    placed = stage_table(placed.select("label", "c1", "c2", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "embed-placed")
    plain = rows.select("id", "label", "c1", "c2", F.col("keys").isNotNull().alias("live"))
    out = plain.where("live").join(placed, ["label", "c1", "c2"]).select("id", "n_links", "component")
    out = out.union(plain.where("not live").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
