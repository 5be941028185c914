"""What test modules share."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    """Values as both engines' results compare: nulls alike, whole floats as integers, bytes as bytes."""
    import pandas as pd

    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(frame, columns):
    return sorted((tuple(norm(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
