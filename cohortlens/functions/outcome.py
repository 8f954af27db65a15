"""Outcome normalisation: text or boolean -> BOOLEAN (NULL when unmapped)."""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import Column, functions as F

from .rules import sql_literal


def outcome_flag_sql(expr: str, values: Optional[Mapping[str, bool]]) -> str:
    if values is None:
        return f"CAST({expr} AS BOOLEAN)"
    whens = " ".join(f"WHEN {expr} = {sql_literal(t)} THEN {sql_literal(bool(b))}" for t, b in values.items())
    return f"CASE {whens} ELSE CAST(NULL AS BOOLEAN) END"


def outcome_flag(col: Column, values: Optional[Mapping[str, bool]]) -> Column:
    """Boolean outcome.  With a text mapping, values outside it become NULL."""
    if values is None:
        return col.cast("boolean")
    mapped = F.create_map(*[F.lit(x) for pair in values.items() for x in (pair[0], bool(pair[1]))])
    return mapped[col]


def unmapped_outcome(raw: Column, flag: Column) -> Column:
    """True where a non-null raw outcome did not map to a boolean."""
    return raw.isNotNull() & flag.isNull()
