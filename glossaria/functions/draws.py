"""Reproducible pseudo-random draws derived from a hash.

A draw depends on the seed and the row key only, never on partitioning, so a
recomputed task yields the same rows and SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: str, *keys: Column) -> Column:
    """Hex digest usable as a random sort key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def draw(seed: str, n: Column, *keys: Column) -> Column:
    """Integer in ``[0, n)`` from 60 hash bits."""
    bits = F.conv(F.substring(hash_key(seed, *keys), 1, 15), 16, 10).cast("bigint")
    return F.when(n > 0, bits % n)
