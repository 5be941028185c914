"""Removal of boilerplate lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import join_frequent, stage_table

#: Lines on this many distinct sites are boilerplate.
MIN_SITES = 5
#: Width of the band round the threshold in which an estimate does not decide: six standard errors of a sketch of 2^12 registers.
NEAR = 0.1


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row per line that is not blank: id, th (hash of the text), site, pos, h1, h2 (128-bit hash of the line)."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = base.select("id", "th", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike("[^ \\t\\r\\f\\x0B]"))
    return rows.select("id", "th", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Every occurrence of the lines on ``min_sites`` sites or more: id, th, pos, and ``first``, the line's smallest (id, pos).

    A HyperLogLog sketch of sites per line hash, merged by aggregation, decides lines far from the threshold; those within
    NEAR (and one site) of it get exact distinct counts. Lines that may be spread are picked from the texts once.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("sites"), F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"))
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    some = spread.where(F.col("sites") >= low).withColumn("total", F.col("n"))
    some = stage_table(join_frequent(lines, some, ["h1", "h2"], "id"), "line-spread")
    near = some.where(F.col("sites") <= high)
    exact = near.where("site is not null").select("h1", "h2", "site", "total").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"), F.max("total").alias("n"))
    near = join_frequent(near, exact.where(F.col("exact") >= min_sites).select("h1", "h2", "n"), ["h1", "h2"], "id")
    return some.where(F.col("sites") > high).select("id", "th", "pos", "first").union(near.select("id", "th", "pos", "first"))


def _cut(docs: DataFrame, min_sites: int, keep_first: bool, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(row_ struct of the input row, text_ without boilerplate, cut_ array of removed line positions or null)."""
    hit = spread_lines(docs, min_sites, id_col, text_col, site_col)
    if keep_first:
        hit = hit.where(~((F.col("first.id") == F.col("id")) & (F.col("first.pos") == F.col("pos"))))
    gone = hit.groupBy(F.col("id").alias("id_"), F.col("th").alias("th_")).agg(F.collect_set("pos").alias("cut_"))
    rows = docs.select(F.struct("*").alias("row_"), F.col(id_col).alias("key_"), F.xxhash64(F.col(text_col)).alias("hash_"), F.col(text_col).cast("string").alias("text_"))
    rows = rows.join(gone, (F.col("key_") == F.col("id_")) & (F.col("hash_") == F.col("th_")), "left")
    left = F.array_join(F.filter(F.split("text_", "\n", -1), lambda x, i: ~F.array_contains("cut_", i)), "\n")
    return rows.select("row_", F.when(F.col("cut_").isNull(), F.col("text_")).otherwise(left).alias("text_"), "cut_")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with boilerplate lines taken out of their texts; no row goes, and all columns stay.

    A line (between newlines, compared exactly) on ``min_sites`` distinct sites or more goes wherever it occurs; with
    ``keep_first`` its occurrence with the smallest (id, position) stays, so no line is lost to the corpus. ``chars_col``,
    if there is such a column, gets the new length.

    Blank lines stay and are not counted. Null texts and texts of rows with a null id stay as they are, and a null site
    counts as none. Rows that share an id are cut each by its own text. A text that loses every line is empty.
    """
    out = _cut(docs, min_sites, keep_first, id_col, text_col, site_col)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("text_").alias(c))
        elif c == chars_col:
            cols.append(F.length("text_").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row_").getField(c).alias(c))
    return out.select(*cols)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, n_lines (blank ones too; 0 for a null text), n_removed, kept_sha256 of the text left.

    A row with a null id loses nothing; a null text is digested as an empty one. Rows that repeat are told of each; an empty
    table gives an empty result.
    """
    out = _cut(docs, min_sites, keep_first, id_col, text_col, site_col)
    text = F.col("row_").getField(text_col)
    return out.select(
        F.col("row_").getField(id_col).alias(id_col),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("cut_").isNull(), 0).otherwise(F.size("cut_")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.col("text_"), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), solid AS (SELECT * FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''
), spread AS (
  SELECT line, min(struct_pack(id := doc_id, pos := pos)) AS first FROM solid GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT s.doc_id, s.pos FROM solid s JOIN spread p ON s.line = p.line WHERE NOT (p.first.id = s.doc_id AND p.first.pos = s.pos)
), sums AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""
