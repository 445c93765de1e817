"""Bounded samples by hash, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(share: float) -> int:
    """The bound under which a 64-bit hash falls with probability ``share``."""
    return -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * share))


def smallest(df: DataFrame, key: Column, limit: int, rows: int) -> DataFrame:
    """Where ``df`` has many more than ``limit`` rows, some 4 * ``limit`` with the smallest hashes ``key``.

    A top-k brings k rows of every task into one; this filter comes before it, so that the sum stays small at
    any number of tasks. It keeps the ``limit`` smallest but for a chance beyond all practice.
    """
    return df.where(key < F.lit(below(4 * limit / rows))) if rows > 8 * limit and limit >= 32 else df
