"""Random numbers that depend on the row's key only.

The same key always draws the same number, whatever the partitioning, so a retried task or a
re-planned stage cannot change a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYS = float(2**32)


def md5_int(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``:``, as a long in [0, 2^32)."""
    text = F.concat_ws(":", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def md5_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1), reproducible in any engine that has MD5."""
    return (md5_int(*parts) + F.lit(0.5)) / F.lit(_KEYS)


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform in (0, 1) from the JVM's 64-bit hash: the fast form for wide factor tables."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def gaussian(seed: int, *parts: Column) -> Column:
    """Standard normal by the Box-Muller transform of two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, F.lit(0), *parts)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, F.lit(1), *parts))


def coin(seed: int, *parts: Column) -> Column:
    """0.0 or 1.0 with equal chance."""
    return F.when(uniform(seed, *parts) < 0.5, 0.0).otherwise(1.0)
