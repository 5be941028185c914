"""A corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A null text
counts as empty, and stays null where its row stays; rows that repeat are judged each; a null doc_id is in no group and no
fold; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, lines, minhash, quality
from keyloom.llm.bpe import encode_documents
from keyloom.llm.labelled import fold
from keyloom.llm.queries import tokenizer_path
from keyloom.llm.tables import drop_staged, read, stage_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject (score of 0.3 or more); it learns outside fold 0 of 5 of the labels. Null
    and empty texts are scored like others."""
    net = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.keep_quality(docs, net)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that spread over sites; every document stays, n_chars is that of the new text."""
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; those without words stay."""
    groups = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(groups, docs.doc_id == groups.gone_, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document; a null or empty text has no ids and an empty decoded text."""
    out = encode_documents(docs, tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", boilerplate_lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier, SimHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written and read again, and deleted when the next one
    has been written. The tables of an empty or odd input pass through like others."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
