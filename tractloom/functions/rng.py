"""Randomness as a pure function of a seed and ids, the same in any partitioning and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12  # hex digits of md5 that are used: 48 bits


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """A double in [0, 1) from md5 of seed and columns joined by ':'."""
    key = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def order_key(seed: int | str, *cols: Column | str) -> Column:
    """A text that orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def normal(seed: int | str, *cols: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform of two uniforms."""
    u, v = uniform(f"{seed}u", *cols), uniform(f"{seed}v", *cols)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(3.141592653589793) * v)
