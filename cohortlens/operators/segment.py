"""SEG: derive all label layers in one projection."""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import DataFrame

from ..config import AuditParams
from ..functions.rules import Segment, reference_segments


def segment(
    df: DataFrame,
    rules: Optional[Mapping[str, Segment]] = None,
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """Add one column per rule (first matching case wins); default = the audit's four layers."""
    rules = reference_segments(params) if rules is None else rules
    return df.withColumns({name: rule.column() for name, rule in rules.items()})
