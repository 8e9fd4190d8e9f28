"""Seeded draws that depend on nothing but their arguments.

A draw is a pure function of ``(seed, label, row id)``.  Partitioning, task retries and lost executors therefore never
change which cells are picked, and another engine with ``md5`` can recompute the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(row_id: Column, label: str, seed: int) -> Column:
    """Eight hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:{label}:"), row_id.cast("string"))), 1, 8)


def draw(row_id: Column, label: str, seed: int = 42) -> Column:
    """A BIGINT in ``[0, 2**32)``."""
    return F.conv(_digits(row_id, label, seed), 16, 10).cast("long")


def picked(row_id: Column, label: str, rate: float, seed: int = 42) -> Column:
    """True for a share ``rate`` of the rows: those whose draw is below ``rate * 2**32``.

    Digits of one width sort like the numbers they stand for, so they are compared as they are.
    """
    limit = int(rate * 2**32)
    return F.lit(True) if limit >= 2**32 else _digits(row_id, label, seed) < F.lit(f"{limit:08x}")
