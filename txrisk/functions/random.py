"""Reproducible pseudo-randomness.

``rand()`` depends on partitioning and changes when a lost task is retried. A hash of
the row id does neither, and any other SQL engine can compute the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_rand(row_id: Column, salt: int | str) -> Column:
    """Uniform double in [0, 1): the leading 32 bits of md5(id:salt)."""
    digest = F.md5(F.concat(row_id.cast("string"), F.lit(f":{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def det_choice(row_id: Column, salt: int | str, n: Column | int) -> Column:
    """Uniform integer in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(det_rand(row_id, salt) * n).cast("int")
