"""Hash-seeded randomness: the same draw on any partitioning, and in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw32(seed: int | str, *keys: Column | str) -> Column:
    """An integer in 0..2**32 - 1 from the seed and the keys."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return draw32(seed, *keys) / F.lit(4294967296.0)


def pick(choices: Column, seed: int | str, *keys: Column | str) -> Column:
    """An element of an array; null for an empty one."""
    return F.get(choices, (draw32(seed, *keys) % F.greatest(F.size(choices), F.lit(1))).cast("int"))
