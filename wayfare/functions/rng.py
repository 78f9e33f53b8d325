"""Reproducible randomness: uniforms that are a pure function of a seed and keys, the same in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: int, *keys: Column | str) -> Column:
    """The first 32 bits of md5('seed|key|...') as a long."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return hash32(seed, *keys) / F.lit(4294967296.0)


def uniform_py(seed: int, *keys) -> float:
    """uniform() in Python, for stateful operators."""
    import hashlib

    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0
