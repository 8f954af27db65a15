"""Column-expression builders (JVM-side, codegen-friendly; no Python UDFs)."""

from .outcome import outcome_flag, unmapped_outcome
from .rules import Segment, reference_segments
from .measures import pct, rounded, share_pct

__all__ = [
    "outcome_flag", "unmapped_outcome", "Segment",
    "reference_segments", "pct", "rounded", "share_pct",
]
