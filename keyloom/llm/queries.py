"""Queries of the ten operations over their whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, substring
from .bpe import encode_digests
from .decontam import find_leaks
from .embed import near_vectors
from .labelled import fold
from .minhash import near_duplicates
from .pii import personal_data
from .quality import quality_scores
from .tables import read
from .toxicity import toxicity_scores

#: The tokenizer file of op1 and of the pipeline, by its name among the public vocabularies.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and decoding digests of all documents."""
    return encode_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(read(spark, sf_dir, "documents"))


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; fold 2 of 4 is held out."""
    return langid.languages(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2)


def op7_recompression_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op8_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines in all documents."""
    return lines.line_report(read(spark, sf_dir, "documents"))


def op10_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Links of all pairs of equal label, then the smallest vec_id reachable, by recursion over labels of components.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), unit AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS low FROM reach GROUP BY a
), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transducer_bpe": op1_transducer_bpe,
    "op2_minmax_dedup": op2_minmax_dedup,
    "op3_boosted_toxicity": op3_boosted_toxicity,
    "op4_field_pii": op4_field_pii,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_kneser_ney_language": op6_kneser_ney_language,
    "op7_recompression_repeats": op7_recompression_repeats,
    "op8_pstable_vectors": op8_pstable_vectors,
    "op9_line_spread": op9_line_spread,
    "op10_byte_quality": op10_byte_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op7_recompression_repeats": substring.ORACLE,
    "op8_pstable_vectors": VECTORS_SQL,
    "op9_line_spread": lines.ORACLE,
}
