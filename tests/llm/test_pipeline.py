"""The pipeline: every stage against a plain version of it, and the whole as the stages in order."""

from helpers import SF_DIR
from llm_data import brute_leak_ids, plain_lines, plain_network
from pyspark.sql import functions as F
from test_pairs import brute_near

import corpus_pipeline as P
from keyloom.llm import quality
from keyloom.llm.labelled import fold
from keyloom.llm.queries import tokenizer_path
from keyloom.llm.tables import read, stage_table


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    net = quality.fit(docs, read(spark, SF_DIR, "labels"), fold(F.col("doc_id"), 5) != 0)
    kept = stage_table(P.quality_filter(spark, docs, SF_DIR), "t")
    likely = {r["doc_id"]: plain_network(net, r["text"].encode()) for r in docs.select("doc_id", "text").collect()}
    found = set(ids(kept))
    assert all((p >= 0.3) == (i in found) for i, p in likely.items() if abs(p - 0.3) > 1e-4) and kept.columns == docs.columns
    cut = stage_table(P.boilerplate_lines(spark, kept, SF_DIR), "t")
    want = plain_lines([tuple(r) for r in kept.select("doc_id", "text", "source").collect()])
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want and cut.columns == docs.columns
    assert cut.where("n_chars <> length(text)").count() == 0
    one = stage_table(P.near_dedup(spark, cut, SF_DIR), "t")
    assert ids(one) == sorted(i for i, _, _, stays in brute_near([tuple(r) for r in cut.select("doc_id", "text").collect()]) if stays)
    assert one.columns == docs.columns
    clean = stage_table(P.decontaminate(spark, one, SF_DIR), "t")
    assert ids(clean) == sorted(set(ids(one)) - brute_leak_ids(one, read(spark, SF_DIR, "benchmark"))) and clean.columns == docs.columns
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in clean.collect()}
    tokens = P.tokenize(spark, clean, SF_DIR).collect()
    assert {r["doc_id"]: (r["ids"], r["n_tokens"], r["decoded"]) for r in tokens} == {i: (t, len(t), library.decode(t, skip_special_tokens=False)) for i, t in texts.items()}
    assert sorted(map(repr, P.run(spark, SF_DIR).collect())) == sorted(map(repr, tokens))


def test_stages_take_odd_rows_and_none(spark, docs):
    whole = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (whole, whole.where("1 = 0")):
        rows = frame.count()
        for _, stage in P.STAGES:
            frame = stage_table(stage(spark, frame, SF_DIR), "t")
        assert (frame.count() > 0) == (rows > 0)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
