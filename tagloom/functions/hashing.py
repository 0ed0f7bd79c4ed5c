"""Deterministic draws: hashes of row keys, independent of how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits are 60 bits, the most that stays positive in a signed 64-bit number.
DRAW_DIGITS = 15


def key_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))


def draw(*parts: Column) -> Column:
    """Uniform integer in ``[0, 2**60)`` that depends only on ``parts``."""
    return F.conv(F.substring(key_hash(*parts), 1, DRAW_DIGITS), 16, 10).cast("bigint")
