"""Settings of a keyspace, and CONFIG GET over them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .keyspace import MAX_DATABASES, MAX_KEY_BYTES

_TIME = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}
_SIZE = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def _number(text: str, units: dict[str, int]) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in units:
        raise ValueError(f"no such amount: {text!r}")
    return int(m[1]) * units[m[2].lower()]


def seconds(text: str) -> int:
    """``90``, ``5m``, ``2h`` or ``1d`` in seconds."""
    return _number(text, _TIME)


def size(text: str, total: int | None = None) -> int:
    """``512``, ``64mb`` or, of ``total``, ``80%`` in bytes."""
    if text.strip().endswith("%"):
        if total is None:
            raise ValueError(f"a share of what: {text!r}")
        return total * int(text.strip()[:-1]) // 100
    return _number(text, _SIZE)


@dataclass(frozen=True)
class Settings:
    """What a keyspace is run with."""

    max_key_length: int = MAX_KEY_BYTES
    databases: int = MAX_DATABASES
    default_ttl: str = "0"
    max_ttl: str = "0"
    eviction_policy: str = "lru"
    eviction_only_ttl: bool = False
    soft_max_keys: int = 0
    hard_max_keys: int = 0
    snapshot_interval: str = "5m"
    snapshot_min_keys_changed: int = 0
    snapshot_min_data_changed: str = "0"
    snapshot_keep: int = 3


def config_get(spark: SparkSession, settings: Settings, *names: str) -> DataFrame:
    """CONFIG GET: (name, value) of the settings with these exact names, or of all for ``*``."""
    rows = [(k.replace("_", "-"), str(v).lower() if isinstance(v, bool) else str(v)) for k, v in asdict(settings).items()]
    wanted = [r for r in rows if "*" in names or r[0] in names]
    return spark.createDataFrame(wanted, "name string, value string")
