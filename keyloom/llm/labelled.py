"""Bounded samples of labelled documents for fitting, and the fold rule that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop_staged, stage_table


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(id_col.cast("string").cast("binary")) % folds).cast("int")


#: Bytes of a sample's texts at most.
SAMPLE_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], float]:
    """At most ``per_class`` labelled texts of each class and ``sample_bytes`` bytes of text (those with the smallest hashes;
    whole texts), and the share of label 1 in all.

    ``keep`` says which labels may be learned. An id with several labels counts as 1 if any is 1; labels other than 0 and 1
    and null ids are left out. Only the ids of the sample, 2 * per_class at most, are sent to the scan of the texts, and the
    sample's texts reach the driver only as far as ``sample_bytes`` allows.
    """
    known = labels.where(keep & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.max(label).cast("int").alias("y"))
    total, ones = known.agg(F.count("*"), F.sum("y")).first()
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id_"), "id_").limit(per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("key_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = stage_table(texts.join(F.broadcast(picked), F.col("key_") == F.col("id_")).select("id_", "t", "y", F.octet_length("t").alias("size"), F.xxhash64("id_").alias("hash")), "labelled")
    left, last = sample_bytes, None
    for r in found.select("hash", "id_", "size").orderBy("hash", "id_").collect():
        left -= r["size"]
        if left < 0:
            break
        last = r["hash"]
    rows = found.where(F.col("hash") <= last).select("id_", "t", "y").collect() if last is not None else []
    drop_staged(found)
    rows = sorted(((r["id_"], r["t"], r["y"]) for r in rows), key=lambda r: (r[0], r[1]))
    return [(t, y) for _, t, y in rows], (ones or 0) / total if total else 0.5
