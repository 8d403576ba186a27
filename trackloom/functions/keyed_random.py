"""Random numbers that depend only on (seed, purpose, row key).

A draw does not depend on partitioning, task retries or row order, so a lost
executor recomputes exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """Uniform in [0, 1) with 52 bits."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def normal(seed: int, purpose: str, *key: Column) -> Column:
    """Standard normal (Box-Muller over two keyed uniforms)."""
    u1 = uniform(seed, purpose + ".r", *key)
    u2 = uniform(seed, purpose + ".a", *key)
    return F.sqrt(-2.0 * F.log(u1 + 2.0 ** -53)) * F.cos(TWO_PI * u2)


def integer(u: Column, lo: Column | int, hi: Column | int) -> Column:
    """Whole number in [lo, hi] from a uniform."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(u * (hi_c - lo_c + 1))).cast("int")
