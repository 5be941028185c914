"""Small tables for the text operations: nulls, empty and long texts, repeats, extra columns whose names clash."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_data import prose  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    base = prose(1, 80)
    words = base.split()
    near = " ".join(words[:40] + ["other"] + words[41:])
    far = " ".join(words[:30] + prose(9, 50).split())
    passage = prose(5, 60)
    out = [base, base, near, far, None, "", "   \n\t", "one two three", "ONE two\tthree", "one two three", prose(2, 30) + " " + passage + " " + prose(3, 20), prose(4, 25) + " " + passage, passage, prose(6, 6000), "x" * 5000, "no no no no " * 12, "é ü " * 20, prose(8, 13), prose(8, 12), prose(8, 13) + " end"]
    return [(i + 1, t) for i, t in enumerate(out)] + [(None, base), (3, "another text under the same id")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id and text among columns with names that the operations use themselves."""
    rows = [(i, t, "en" if n % 2 else None, f"s{n % 7}", len(t or ""), n, "x", n, [n], n) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, bands array<long>, rep long").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("1 = 0")
