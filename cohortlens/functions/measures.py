"""Column-form measure helpers shared by the DataFrame operators.

Arithmetic order follows each audit (``n / d * 100`` for rates,
``100.0 * n / total`` for shares) and every literal is a DOUBLE, never a
decimal, so results stay DOUBLE.  Ratios that can meet an empty cohort use
``try_divide`` and give NULL instead of failing under ANSI mode.  Single
figures over rows or cube cells are ``operators.metrics.Metric`` specs.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, functions as F


def rounded(col: Column, digits: Optional[int]) -> Column:
    return col if digits is None else F.round(col, digits)


def pct(num: Column, den: Column) -> Column:
    """num / den * 100 (NULL when den = 0)."""
    return F.try_divide(num, den) * F.lit(100.0)


def share_pct(n: Column, total: Column) -> Column:
    """100.0 * n / total (share-of-volume order)."""
    return F.try_divide(F.lit(100.0) * n, total)
